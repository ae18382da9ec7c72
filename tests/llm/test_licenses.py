import random
import re

from textloom.llm import licenses

SPLIT = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return [w for w in SPLIT.split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]


def brute(t):
    w = words(t)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_columns(docs, texts):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in texts), key=repr)


def test_notices_exact_edited_and_absent(spark):
    mit = licenses.NOTICES["mit"]
    edited = mit.replace("free of charge,", "entirely free of charge,").replace("modify, merge,", "modify,")
    rows = [(1, "x y z " + mit), (2, "w " * 500 + edited + " w" * 500), (3, " ".join(mit.split()[:15])), (4, "MIT License MIT License\ngnu general-public license"), (5, licenses.NOTICES["gpl"] * 3), (6, None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and got[1].score == 1.0
    assert got[2].labels == "mit" and 0.5 <= got[2].score < 1.0
    assert got[3].labels == "" and got[3].score == 0.0
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].labels) == (3, 0, 4, "gpl,mit")
    assert got[5].labels == "gpl" and got[5].n_base == 3
    assert (got[6].n_words, got[6].n_base, got[6].labels) == (0, 0, "")


def test_empty(no_docs):
    assert licenses.scan(no_docs).count() == 0


def test_notices_are_recalled_with_edits_and_clean_words_are_not(spark):
    """Of notices with one word in twenty-five changed, left out or put in, at least nine in ten are found."""
    rng, rows = random.Random(9), []
    filler = lambda n: " ".join(rng.choice(("permission", "the", "software", "licensed", "free", "copy", "use", "x1", "work", "this")) for _ in range(n))
    for label, notice in sorted(licenses.NOTICES.items()):
        for n in range(40):
            out = []
            for w in notice.split():
                out += [w] if rng.random() >= 0.04 else rng.choice(([], ["other"], [w, "other"]))
            rows.append((len(rows), f"{filler(30)} {' '.join(out)} {filler(30)}", label))
    rows += [(len(rows) + k, filler(400), "") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.scan(df).collect()}
    hit = [label in got[i] for i, _, label in rows if label]
    assert sum(hit) >= 0.9 * len(hit), sum(hit) / len(hit)
    assert all(not got[i] for i, _, label in rows if not label)
    print("notices found", sum(hit) / len(hit))


def test_a_place_counts_once(spark):
    words = licenses.NOTICES["bsd"].split()
    part = " ".join(words[:10])  # the same tenth part over and over is no notice
    row = licenses.scan(spark.createDataFrame([(1, f"{part} {part} {part} {part} {part}")], "doc_id long, text string")).first()
    assert row.labels == "" and row.score == 0.0
