"""Keyed tables: whole counts, repeated keys, and how often rows move."""

import glob
import random

import pytest
from textloom.operators import tables as B
from textloom.runtime import shared_dir
from textloom.sources import derived as D

ROWS = "table_key long, row_key long, c string"


def moves(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_matches_are_counted_to_the_last(spark):
    schema = "table_key long, row_key long, name string"
    source = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (2, 2, "x"), (3, 9, "x"), (4, None, "y")], schema)
    remote = spark.createDataFrame([(t, k, "x") for t in (11, 12, 13) for k in (1, 2)] + [(14, 2, "x"), (15, None, "y"), (16, 1, "z")], schema)
    assert {r.table_key: (r.n, r.state) for r in B.match_tables(source, remote, "name").collect()} == {1: (4, "ambiguous"), 2: (4, "ambiguous"), 3: (0, "missing"), 4: (1, "matched")}


def test_rows_move_once_to_be_matched(spark):
    base = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (2, 1, "a"), (2, 5, "b")], ROWS)
    cur = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (1, 3, "z"), (2, 1, "a"), (2, 6, "b")], ROWS)
    got = B.match_rows(base, cur, ["c"])
    assert sorted((r.table_key, r.base_row, r.current_row, r.how) for r in got.collect()) == [*[(1, 1, 1, "key")] * 4, (2, 1, 1, "key"), (2, 5, 6, "rename")]
    diff = B.table_diff(base, cur, ["c"], allow_rename=True)
    want = [*[(1, 1, "updated", "c")] * 4, (1, 2, "deleted", ""), (1, 3, "added", ""), (2, 6, "updated", "row_key")]
    assert sorted((r.table_key, r.row_key, r.change, r.cells) for r in diff.collect()) == want
    assert moves(B.match_rows(base, cur, ["c"])) == moves(B.table_diff(base, cur, ["c"], allow_rename=True)) == 1


def test_blockers_need_two_tables_of_keys_and_no_windows_of_changed_copies(spark):
    written = lambda: {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in glob.glob(f"{shared_dir(spark)}/textloom-*")}
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 2)], "table_key long, row_key string, pos long")
    source = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "b", 2)], "table_key long, row_key string, pos long")
    heads = spark.createDataFrame([(1, ["k"]), (2, ["k"])], "table_key long, headers array<string>")
    before = written()
    assert [tuple(r) for r in B.table_blockers(rows, source, heads, heads).collect()] == [(1, "reorders-rows", None)]
    assert written() - before <= {"textloom-table-keys", "textloom-running"}
    base, cur, _ = D.tables(spark, "/root/testdata/sf0.001")
    assert "Window" not in cur._jdf.queryExecution().optimizedPlan().toString() and base.count() > 0


@pytest.mark.parametrize("few", [0, 5, 64])
def test_tables_meet_whether_their_identity_has_few_rows_or_many(spark, monkeypatch, few):
    monkeypatch.setattr(B, "FEW_ROWS", few)
    rng = random.Random(few)
    made = lambda tables: [(t, rng.choice([None, 1, 2, 3, 4, 5]), name if rng.random() < 0.9 else rng.choice(["x", "y", None])) for t in tables for name in [rng.choice(["x", "y", *"abcdefgh"])] for _ in range(rng.randint(1, 4))]
    source, remote = made(range(40)), made(range(100, 140))
    source, remote = source + [(90, k, i) for t, k, i in source if t == 3] + [(None, 1, "x")], remote + [(190 + n, k, i) for t, k, i in remote if t < 110 for n in (0, 10)] + [(None, 1, "x")]
    met = lambda s: len({r for r, k, i in remote for t, l, j in source if t == s and r is not None and i is not None and (k, i) == (l, j)})
    frame = lambda rows: spark.createDataFrame(rows, "table_key long, row_key long, name string").repartition(3)
    got = B.match_tables(frame(source), frame(remote), "name").collect()
    assert sorted((r.table_key or -1, r.n) for r in got) == sorted((t or -1, met(t) if t is not None else 0) for t in {t for t, _, _ in source})
    assert all(r.state == ("missing", "matched", "ambiguous")[min(r.n, 2)] for r in got)


def test_tables_of_few_rows_meet_without_pairs_of_rows(spark):
    rows = spark.createDataFrame([(t, k, f"n{t // 2}") for t in range(20) for k in range(4)], "table_key long, row_key long, name string")
    before = glob.glob(f"{shared_dir(spark)}/textloom-*")
    got = B.match_tables(rows, rows, "name")
    names = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{shared_dir(spark)}/textloom-*")) - set(before)}
    assert names == {"textloom-table-sizes", "textloom-many-rows"}
    assert {(r.table_key, r.n) for r in got.collect()} == {(t, 2) for t in range(20)}
