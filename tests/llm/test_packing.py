import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from textloom.llm import packing
from textloom.llm.wordids import WordMemo
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(texts):
    tok = Tokenizer.from_file(PATH)
    return Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in texts)


@pytest.mark.parametrize("window,targets,queues", [(4096, None, 1024), (64, None, 1024), (100, {"s0": 0.5, "s1": 0.3, "s2": 0.2}, 1024), (64, None, 2)])
def test_every_id_once_and_gapless(docs, texts, window, targets, queues):
    rows = packing.pack(docs, PATH, targets=targets, window=window, max_queues=queues).collect()
    want = Counter()
    for (i, ids), n in expected(texts).items():
        want[i, len(ids)] += n
    total = sum(len(ids) * n for (_, ids), n in expected(texts).items())
    assert sum(r.length for r in rows) == total
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    padding = 0
    for s, pieces in sequences.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == pieces[0].sequence_length <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert sorted(sequences) == list(range(len(sequences)))
    assert padding < window
    starts = Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert starts == want


def test_checksums_are_those_of_the_ids(docs, texts):
    crc = defaultdict(set)
    for i, ids in expected(texts):
        crc[i, len(ids)].add(ids)
    for r in packing.pack(docs, PATH, window=128).collect():
        parts = {zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) for ids in crc[r.doc_id, r.doc_tokens]}
        assert r.ids_crc32 in parts


def test_windows_hold_the_mixture(docs):
    rows = packing.pack(docs, PATH, window=500).collect()
    all_tokens = Counter()
    for r in rows:
        all_tokens[r.source] += r.length
    total = sum(all_tokens.values())
    by = defaultdict(Counter)
    for r in rows:
        if r.sequence_length == 500:
            by[r.sequence_id][r.source] += r.length
    for counts in by.values():
        for source, n in all_tokens.items():
            assert abs(counts[source] - 500 * n / total) <= 2 * len(all_tokens)


def test_targets_are_met_until_a_source_runs_dry(docs):
    rows = packing.pack(docs, PATH, window=400, targets={"s0": 0.25, "s1": 0.25, "s2": 0.5}).collect()
    first = Counter()
    for r in rows:
        if r.sequence_id == 0:
            first[r.source] += r.length
    assert abs(first["s0"] - 100) <= 4 and abs(first["s2"] - 200) <= 4 and first[""] == 0


def test_large_counts_stay_exact():
    plan = packing.Plan(["a", "b", "c"], [10**13, 7, 10**12 + 1], None, 4096)
    for queue, token in ((0, 10**13 - 5), (1, 0), (1, 6), (2, 10**12 - 3)):
        row, start, length, seq, offset, size = plan.pieces(np.array([queue]), np.array([token]), np.array([1]))
        assert length.tolist() == [1] and 0 <= offset[0] < size[0]
    ends = [plan.pieces(np.array([q]), np.array([0]), np.array([n]))[2].sum() for q, n in ((1, 7),)]
    assert ends == [7]


def test_empty(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0


def test_many_sources_keep_shares_and_targets(spark):
    rows = [(s * 4 + k, "one two three four " * 40, f"s{s}") for s in range(12) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    by = defaultdict(Counter)
    for r in packing.pack(df, PATH, window=240, max_queues=2).collect():
        by[r.sequence_id if r.sequence_length == 240 else -1][r.source] += r.length
    assert len(by) > 20 and sum(sum(c.values()) for c in by.values()) == 48 * 161
    for s, counts in by.items():  # each window holds each of twelve equal sources
        assert s < 0 or all(abs(counts[f"s{k}"] - 20) <= 4 for k in range(12)), counts
    first = Counter()
    for r in packing.pack(df, PATH, window=200, targets={"s3": 0.75, "s7": 0.25}, max_queues=2).collect():
        if r.sequence_id == 0:
            first[r.source] += r.length
    assert set(first) == {"s3", "s7"} and abs(first["s3"] - 150) <= 2


SIGNS = [*"abzIİıßſKÅéñΣς.,'’-_ \n\t0١²日한ǅŉŐ", "\u0307", "e\u0301", "İ.", "İ,", "Σ.", "'s", "'ll", "<|endoftext|>", "\u2003", "\x85", "\x1c", "\u200b", "ﬁ", "\u0345", "👍", "\U0001e900", "x" * 70]


def test_ids_are_the_librarys():
    rng, memo = random.Random(7), WordMemo(PATH)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    got = [x for k in range(0, len(texts), 500) for x in memo.encode_all(texts[k : k + 500])]
    want = memo.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert memo.by_words
    assert [np.frombuffer(x, memo.dtype).tolist() for x in got] == [x.ids for x in want]


def test_another_tokenizer_encodes_whole_texts():
    memo = WordMemo(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["two  spaces\n and a line", "", "İ. end"]
    assert not memo.by_words
    assert [np.frombuffer(x, memo.dtype).tolist() for x in memo.encode_all(texts)] == [x.ids for x in memo.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_long_document_of_one_of_many_sources_takes_little_memory():
    plan = packing.Plan([f"s{i}" for i in range(1000)], [2_000_000] * 1000, None, 4096)
    tracemalloc.start()
    _, start, length, *_ = plan.pieces(np.array([5]), np.array([1000]), np.array([200_000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert length.sum() == 200_000 and sorted(start.tolist())[0] == 0 and peak < 100 << 20


def test_three_thousand_sources(spark):
    df = spark.createDataFrame([(i, "one two three " * 20, f"s{i}") for i in range(3000)], "doc_id long, text string, source string")
    rows = packing.pack(df, PATH).collect()
    assert sum(r.length for r in rows) == 3000 * 61 and {r.source for r in rows if r.sequence_id == 0} == {f"s{i}" for i in range(3000)}
