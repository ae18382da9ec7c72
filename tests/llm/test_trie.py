import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from textloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, `key` string, depth string, part string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def make_rows():
    rng = random.Random(9)
    out = []
    for c in [*range(0, 60), *range(95, 130), 205, 207, 350, -3, -150, None]:
        if c == 100:
            continue  # a hundred without its first conversation
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            out.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "é\U0001f600", "x" * 30])))
    out += [(c, t, "user", f"the same {t}") for c in range(400, 440) for t in range(4)]
    out += [(500, t, "user", f"long {t}") for t in range(300)] + [(501, t, "user", f"long {t}") for t in range(200)] + [(600, 0, "user", "long " * 20_000)]
    out += [(205, None, "user", "first"), (205, None, "user", "first"), (207, 1, None, None)]
    return [(*r, "x", "y", "z") for r in out]


def brute(rows, shared):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        if shared and c is not None:
            h = zlib.crc32(str(c).encode()) % 6
            turns = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    order = lambda c: (c is None, c or 0)
    low = {node: min(m, key=order) for node, m in members.items()}
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += node not in children
    text = lambda ids: ",".join("null" if c is None else str(c) for c in sorted(ids, key=order))
    return [(low[n], len(n), low[n[:-1]] if n else None, len(m), children.get(n, 0), leaves[n], saved[n], hashlib.sha256(text(ends.get(n, [])).encode()).hexdigest()) for n, m in members.items()]


@pytest.mark.parametrize("shared", [None, trie.hundreds])
@pytest.mark.parametrize("band", [trie.BAND, 7])
def test_nodes(spark, many_ranges, shared, band):
    df = spark.createDataFrame(make_rows(), SCHEMA).repartition(5)
    got = [tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(df, shared, band=band).collect()]
    assert sorted(got, key=repr) == sorted(brute(make_rows(), shared), key=repr)


def test_turnless_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 4)
    rows = [(c, t, "user", "gone") for t in range(3)]
    got = [tuple(r[k] for k in COLUMNS) for r in trie.prefix_trie(spark.createDataFrame(rows, schema), trie.hundreds).collect()]
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    empty = trie.prefix_trie(spark.createDataFrame([], schema), trie.hundreds)
    assert empty.count() == 0 and set(empty.columns) == set(COLUMNS)


def test_a_long_list_of_ids_is_cut(spark, many_ranges, monkeypatch):
    monkeypatch.setattr(trie, "IDS_AT_ONCE", 10)
    rows = [(c, 0, "user", "same") for c in range(-50, 400)] + [(c, 0, "user", str(c)) for c in range(400, 420)]
    got = {r.conv_id: r.ends_sha256 for r in trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).filter("depth = 1").collect()}
    assert got[-50] == hashlib.sha256(",".join(map(str, range(-50, 400))).encode()).hexdigest()
    assert got[405] == hashlib.sha256(b"405").hexdigest()


def test_the_queue_spills():
    rng = random.Random(1)
    messages = [(rng.randrange(50), rng.randbytes(2), i) for i in range(5000)]
    queue = trie.SpillingQueue(64)
    for m in messages:
        queue.push(m)
    assert queue.runs
    got = [m for place in sorted({m[:2] for m in messages}) for m in queue.pop_all(place)]
    assert sorted(got) == sorted(messages) and [m[:2] for m in got] == sorted(m[:2] for m in messages) and not queue
