import re
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from textloom.llm import repetition
from textloom.llm.repetition import Rules


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def in_windows(words, k):
    places = defaultdict(list)
    for i in range(len(words) - k + 1):
        places[tuple(words[i : i + k])].append(i)
    return len({p for own in places.values() if len(own) > 1 for i in own for p in range(i, i + k)})


def repeats(words, at_least):
    """Longest repeated substring, and how many of ``at_least`` words can be made longer on neither side."""
    places = defaultdict(list)
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            places[tuple(words[i:j])].append(i)
    again = {s: own for s, own in places.items() if len(own) > 1}
    ways = lambda s, own: (len({words[i - 1] if i else None for i in own}), len({words[i + len(s)] if i + len(s) < len(words) else None for i in own}))
    return max(map(len, again), default=0), sum(len(s) >= at_least and min(ways(s, own)) > 1 for s, own in again.items())


def brute(text, window, at_least):
    w = words_of(text)
    return (len(w), in_windows(w, window), in_windows(w, at_least), *repeats(w, at_least))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n", max_size=40), st.lists(st.sampled_from(["x", "yy", "é"]), max_size=24).map(" ".join)), max_size=6), st.integers(1, 5))
def test_suffix_array_against_all_substrings(texts, at_least):
    got = list(zip(*(x.tolist() for x in repetition.repetition(pa.array(texts, pa.string()), 3, at_least))))
    assert got == [brute(t, 3, at_least) for t in texts]


@pytest.fixture(scope="module")
def odd_docs(spark):
    passage = " ".join(f"w{i}" for i in range(210))
    lone = " ".join(f"v{i}" for i in range(2000))
    texts = [None, "", " \n\t", "a a a", "x\n\nx\n x\nx \n", "# * $% plain & | <b> #", lone, passage + " " + lone + " " + passage, "q " * 60_000, " ".join(f"u{i % 40}" for i in range(80)), lone[:400] + " one two three four five six seven eight nine " + lone[400:800] + " one two three four five six seven eight nine", "é\x1c日本 \x85 \U0001f600 " * 30]
    rows = [(i, t, i, i) for i, t in enumerate(texts)] + [(3, "a a a", 3, 3), (None, lone, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words long, kept long").repartition(3)


def test_rules(odd_docs):
    got = sorted(map(tuple, repetition.quality_rules(odd_docs).collect()), key=repr)
    want = []
    for r in odd_docs.collect():
        t, w = r.text or "", words_of(r.text)
        lines = [x for x in t.split("\n") if words_of(x)]
        covered = {k: in_windows(w, k) for k in (3, 8, 201)}
        failed = len(w) < 50 or 100 * covered[3] > 50 * len(w)
        kept = not failed and 100 * covered[8] <= 30 * len(w) and not covered[201]
        want.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), covered[3], failed, kept, covered[8]))
    assert [x[:9] for x in got] == sorted(want, key=repr)
    by_id = {r[0]: r for r in got}
    assert by_id[7][9:] == (210, 1) and not by_id[7][7]  # nothing but one long passage, twice
    assert by_id[8][9] == 59_999 and by_id[6][7]


def test_keeping_rows(spark, odd_docs, no_docs):
    rules = Rules(min_words=3, max_window_percent=100, max_covered_percent=100, max_repeat=250)
    kept = repetition.keep_varied(odd_docs, rules)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd_docs.collect() if len(words_of(r.text)) >= 3 and r.doc_id != 8)
    assert repetition.quality_rules(no_docs).count() == 0 and repetition.keep_varied(no_docs).columns == no_docs.columns


def test_batches_of_many_texts_are_cut(monkeypatch):
    monkeypatch.setattr(repetition, "BYTES_AT_ONCE", 10)
    texts = pa.array(["abc", None, "x" * 40, "", "abcdef", "abcdef"])
    pieces = list(repetition._pieces(texts))
    assert [i for start, n in pieces for i in range(start, start + n)] == list(range(6)) and len(pieces) > 2
