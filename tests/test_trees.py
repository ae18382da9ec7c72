"""Faults of snapshots and op logs, one literal case each."""

from textloom.operators import audits, trees

NODES = [("root", None, 0), ("a", "root", 0), ("b", "root", 1), ("c", "root", 2), ("k", "b", 0)]
OPS = "op_id string, op_seq long, kind string, target_id string, expected_hash string, parent_id string, after_id string, before_id string"


def nodes(spark):
    return spark.createDataFrame([(b, p, i, f"h{b}") for b, p, i in NODES], "block_id string, parent_id string, pos long, hash string")


OP_CASES = [
    (("replace", "b", "hb", None, None, None), []),
    (("replace", "b", "old", None, None, None), ["hash-mismatch"]),
    (("replace", "root", None, None, None, None), ["root-change"]),
    (("delete", "gone", None, "root", None, None), ["missing-target"]),
    (("delete", "k", "hk", "root", None, None), ["not-a-child"]),
    (("delete", "k", None, "nowhere", None, None), ["missing-parent"]),
    (("insert", "new", None, "root", "a", "b"), []),
    (("insert", "new", None, "root", "root", "a"), []),
    (("insert", "new", None, "root", "a", "c"), ["not-adjacent"]),
    (("insert", "new", None, "root", "c", "a"), ["not-adjacent"]),
    (("insert", "new", None, "root", "k", None), ["anchor-not-child"]),
    (("insert", "new", None, "root", "gone", None), ["missing-anchor"]),
    (("insert", "b", None, "root", "a", None), ["target-exists"]),
    (("move", "c", None, "root", "a", None), []),
    (("move", "c", None, "root", "b", None), ["same-place"]),
    (("move", "a", None, "root", "root", None), ["same-place"]),
    (("move", "a", None, "root", "a", None), ["moving-anchor"]),
]


def test_op_faults(spark):
    own = lambda i, op: (op[0], f"new{i}" if op[1] == "new" else op[1], *op[2:])  # noqa: E731  new blocks of different ops
    ops = spark.createDataFrame([(f"x{i}", i, *own(i, op)) for i, (op, _) in enumerate(OP_CASES)], OPS)
    got = {(r.op_seq, r.fault) for r in audits.validate_ops(ops, nodes(spark)).collect()}
    assert got == {(i, fault) for i, (_, want) in enumerate(OP_CASES) for fault in want}


def test_expected_hashes_go_no_further_than_their_targets(spark):
    ops = spark.createDataFrame([("x", 1, "delete", "b", "old", "root", None, None)], OPS)
    plan = audits.validate_ops(ops, nodes(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: plan.index("expected_hash")].count("Join ") >= 4  # the joins with parents, first children, anchors and copies lie above


def test_ops_without_places_and_empty_logs(spark):
    ops = spark.createDataFrame([("x", 1, "delete", "b", "hb"), ("x", 2, "move", "c", None)], "op_id string, op_seq long, kind string, target_id string, expected_hash string")
    assert {(r.op_seq, r.fault) for r in audits.validate_ops(ops, nodes(spark)).collect()} == {(1, "duplicate-op"), (2, "duplicate-op")}
    assert audits.validate_ops(ops.limit(0), nodes(spark)).isEmpty() and audits.validate_ops(ops, nodes(spark).limit(0)).count() == 4


def test_conditions_fail_when_the_place_changed(spark):
    ops = spark.createDataFrame([("m", 1, "move", "c", "hc", "root", "a", None), ("i", 2, "insert", "n", None, "b", "b", None)], OPS)
    conditions = audits.preconditions(ops, nodes(spark))
    assert all(r.holds for r in audits.check_preconditions(conditions, nodes(spark)).collect())
    changed = nodes(spark).filter("block_id <> 'b'").replace({"hc": "other"})
    got = {(r.op_id, r.what): r.holds for r in audits.check_preconditions(conditions, changed).collect()}
    assert got == {("m", "exists"): True, ("m", "hash"): False, ("m", "parent"): True, ("m", "next"): False, ("i", "first"): False}


def test_moved_blocks_stand_behind_their_anchor(spark):
    ops = spark.createDataFrame([("m", 1, "move", "c", None, "root", "a", None), ("f", 2, "move", "b", None, "root", "root", None), ("d", 3, "delete", "k", None, "b", None, None)], OPS)
    after = spark.createDataFrame([("root", None, 0), ("a", "root", 0), ("c", "root", 1), ("b", "root", 2)], "block_id string, parent_id string, pos long")
    assert {r.op_id: r.done for r in audits.check_readback(ops, after).collect()} == {"m": True, "f": False, "d": True}


def test_siblings_of_one_parent_over_many_ranges(spark, many_ranges):
    rows = [(f"b{i}", "p" if i % 10 else f"q{i}", i // 2) for i in range(1000)]
    blocks = spark.createDataFrame(rows, "block_id string, parent_id string, pos long").repartition(7)
    got = {r.block_id: (r.ordinal, r.previous, r.following) for r in trees.siblings(blocks).collect()}
    line = [b for _, b in sorted((pos, b) for b, p, pos in rows if p == "p")]
    assert all(got[b] == (i, line[i - 1] if i else None, line[i + 1] if i + 1 < len(line) else None) for i, b in enumerate(line))
    assert all(got[b] == (0, None, None) for b, p, _ in rows if p != "p") and len(got) == 1000


#: Blocks besides r, a below r and b below a; lists of children; faults.
SNAPSHOTS = [
    ([], [("r", "a"), ("a", "b")], set()),
    ([("a", "r")], [("r", "a"), ("a", "b")], {("a", "duplicate-id")}),
    ([], [("r", "a"), ("a", "b"), ("a", "b")], {("a", "duplicate-child")}),
    ([], [("r", "a"), ("a", "b"), ("b", "zz")], {("b", "missing-child")}),
    ([], [("r", "a"), ("a", "b"), ("r", "b")], {("b", "conflicting-parents")}),
    ([], [("r", "a"), ("a", "b"), ("b", "r")], {("r", "root-referenced")}),
    ([], [("r", "a")], {("b", "unreferenced"), ("b", "unreachable")}),
    ([], [("r", "a"), ("r", "b")], {("b", "parent-disagrees")}),
    ([], [("a", "b"), ("b", "a")], {("a", "parent-disagrees"), ("a", "unreachable"), ("b", "unreachable")}),
    ([("c", "zz")], [("r", "a"), ("a", "b"), ("r", "c")], {("c", "missing-parent"), ("c", "parent-disagrees")}),
]


def test_snapshot_faults(spark):
    """Each case is a tree of its own in one table of blocks."""
    blocks, lists, want = [], [], set()
    for i, (extra, refs, faults) in enumerate(SNAPSHOTS):
        named = lambda x, i=i: None if x is None else f"{i}{x}"
        blocks += [(named(b), named(p), 0) for b, p in [("r", None), ("a", "r"), ("b", "a"), *extra]]
        lists += [(named(p), named(c)) for p, c in refs]
        want |= {(named(b), f) for b, f in faults}
    refs = spark.createDataFrame(lists, "parent_id string, child_id string")
    df = spark.createDataFrame(blocks, "block_id string, parent_id string, pos long")
    assert {(r.block_id, r.fault) for r in trees.validate_snapshot(df.withColumn("snapshot", trees.F.substring("block_id", 1, 1)), refs, snapshot="snapshot").collect()} == want
    assert trees.validate_snapshot(df.limit(0), refs).isEmpty()


def test_exactly_one_root_and_one_insert_of_an_id(spark):
    faults = lambda *rows: {tuple(r) for r in trees.validate_snapshot(spark.createDataFrame(list(rows), "block_id string, parent_id string, pos long")).collect()}
    assert faults(("a", None, 0), ("b", "a", 0)) == set()
    assert faults(("a", None, 0), ("b", None, 1)) == {("a", "several-roots"), ("b", "several-roots")}
    assert faults(("a", "b", 0), ("b", "a", 0)) == {(None, "no-root"), ("a", "unreachable"), ("b", "unreachable")}
    ops = spark.createDataFrame([("x", 0, "insert", "new", None, "root", "a", None), ("y", 1, "insert", "new", None, "root", "b", None)], OPS)
    assert {(r.op_id, r.fault) for r in audits.validate_ops(ops, nodes(spark)).collect()} == {("x", "inserted-twice"), ("y", "inserted-twice")}
