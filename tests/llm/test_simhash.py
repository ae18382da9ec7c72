import random
from collections import Counter

import xxhash
from textloom.llm import components, simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_whole_operator(docs, texts):
    known = [(i, t) for i, t in texts if i is not None]
    fps = [brute_fingerprint(t) for _, t in known]
    roots = brute_components(fps)
    least = {}
    for (i, _), r in zip(known, roots):
        least[r] = min(least.get(r, i), i)
    want = Counter((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(known, fps, roots))
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs.filter("doc_id is not null")).collect())
    assert got == want


def test_a_very_long_text():
    text = " ".join(f"w{i * i % 4001}" for i in range(70_000))
    assert len(text.split()) > simhash.HASHES_AT_ONCE
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_runs_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        test_components_of_planted_fingerprints(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_of_planted_fingerprints(spark):
    rng = random.Random(8)
    fps = [0, (1 << 64) - 1]
    for _ in range(60):
        centre = rng.getrandbits(64)
        fps.append(centre)
        for _ in range(rng.randint(0, 12)):
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            fps.append(centre)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.fp: r.root for r in simhash.near_duplicate_components(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = brute_components(fps)
    groups = {}
    for f, w in zip(signed, want):
        groups.setdefault(w, set()).add(got[f])
    assert len(got) == len(fps)
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_long_runs_are_cut_without_losing_links(monkeypatch):
    import numpy as np

    rng = random.Random(4)
    segment = rng.getrandbits(21)
    fps = set()
    for _ in range(150):
        x = rng.getrandbits(43) << 21
        for _ in range(3):
            fps.add(x | segment)
            x ^= sum(1 << b for b in rng.sample(range(21, 64), rng.randint(1, 5)))
    fps = np.array(sorted(fps), dtype=np.uint64)
    monkeypatch.setattr(simhash, "LONG_RUN", 10)
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in simhash.run_links(0, fps):
        root[find(int(a))] = find(int(b))
    want = brute_components([int(f) for f in fps])
    pairs = {(w, find(int(f))) for w, f in zip(want, fps)}
    assert len(pairs) == len(set(want)) == len({p[1] for p in pairs})


def test_a_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and got[501] == 500 and len(got) == 203


def test_dropping(docs, texts):
    kept = simhash.drop_near_duplicates(docs.filter("doc_id is not null"))
    assert kept.columns == docs.columns
    want = {r.component_id for r in simhash.near_duplicates(docs.filter("doc_id is not null")).collect()}
    assert {r.doc_id for r in kept.collect()} == want


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.drop_near_duplicates(no_docs).count() == 0
