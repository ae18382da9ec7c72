"""Keyed tables: correspondence, diff and three-way merge of rows and cells.

A table is the rows of one ``table_key``; ``row_key`` names a row in it and ``cells`` are its other columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ranges import running
from textloom.runtime import materialize

KEYS = ["table_key", "row_key"]
#: Tables of an identity with at most so many rows meet all at once.
FEW_ROWS = 64


def key_issues(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are empty or occur more than once, with their count."""
    empty = reduce(lambda a, b: a | b, (F.col(k).isNull() | (F.col(k).cast("string") == "") for k in keys))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("issue", F.when(empty, "empty").when(F.col("n") > 1, "duplicate")).filter("issue is not null")


def _pair(base: DataFrame, current: DataFrame, cells: list[str], names: tuple[str, str]) -> DataFrame:
    a, b = (df.select(*KEYS, *(F.col(c).alias(f"{n}_{c}") for c in cells), F.lit(True).alias(f"in_{n}")) for df, n in zip((base, current), names))
    return a.join(b, KEYS, "full_outer")


def _differs(cells: list[str], a: str, b: str) -> dict[str, Column]:
    return {c: ~F.col(f"{a}_{c}").eqNullSafe(F.col(f"{b}_{c}")) for c in cells}


def table_diff(remote: DataFrame, source: DataFrame, cells: list[str], allow_rename: bool = False, order: str = "row_key") -> DataFrame:
    """Rows that were added, deleted or updated, with the names of changed cells. A deletion is a blocker.

    With ``allow_rename`` a row whose key alone seems new (see ``match_rows``) is an update of ``row_key`` and of the
    cells that differ, under its new key.
    """
    if allow_rename:
        rows = _matched(remote, source, cells, order).withColumn("old_key", F.when(F.col("renamed"), F.col("row_key"))).withColumn("row_key", F.when(F.col("renamed"), F.col("new_key")).otherwise(F.col("row_key")))
        side = lambda mine, n: F.collect_list(F.when(mine, F.struct(*(F.col(c).alias(f"{n}_{c}") for c in (*cells, "old_key")), F.lit(True).alias(f"in_{n}")))).alias(n)
        met = rows.groupBy(*KEYS).agg(side(F.col("in_base"), "r"), side(~F.col("in_base"), "s"))
        pairs = F.when((F.size("r") > 0) & (F.size("s") > 0) & F.col("row_key").isNotNull() & F.col("table_key").isNotNull(), F.flatten(F.transform("r", lambda x: F.transform("s", lambda y: F.struct(x.alias("r"), y.alias("s"))))))
        alone = lambda n: F.transform(n, lambda x: F.struct(*(x.alias(m) if m == n else F.get(F.col(m), F.lit(-1)).alias(m) for m in ("r", "s"))))
        j = met.select(*KEYS, F.explode(F.coalesce(pairs, F.concat(alone("r"), alone("s")))).alias("p")).select(*KEYS, "p.r.*", "p.s.*")
        differs = {"row_key": F.col("r_old_key").isNotNull()} | _differs(cells, "r", "s")
    else:
        j, differs = _pair(remote, source, cells, ("r", "s")), _differs(cells, "r", "s")
    names = F.array_compact(F.array(*(F.when(d, F.lit(c)) for c, d in differs.items())))
    change = F.when(F.col("in_r").isNull(), "added").when(F.col("in_s").isNull(), "deleted").when(F.size(names) > 0, "updated")
    out = j.withColumn("change", change).filter("change is not null")
    return out.select(*KEYS, "change", F.when(F.col("change") == "updated", F.array_join(names, ",")).otherwise("").alias("cells"), (F.col("change") == "deleted").alias("blocker"))


def table_blockers(remote: DataFrame, source: DataFrame, remote_headers: DataFrame, source_headers: DataFrame, allow_header_changes: bool = False, renamed: DataFrame | None = None) -> DataFrame:
    """Why a source table can't be written over the remote one: (table_key, blocker, row_key), each once.

    Rows have table_key, row_key and pos; headers (table_key, headers) are arrays of names; ``renamed`` (table_key,
    base_row, current_row) are rows of ``match_rows`` that go on under another key. Tables on one side only have none.

    headers-differ (names, or only their number if changes are allowed); source- and remote-empty-key and
    -duplicate-key; deletes-row; reorders-rows (all remote rows are there, in another order; told of tables without
    key faults).
    """
    both = remote_headers.select("table_key", F.col("headers").alias("rh")).join(source_headers.select("table_key", F.col("headers").alias("sh")), "table_key")
    differ = F.size("rh") != F.size("sh")
    if not allow_header_changes:
        differ = differ | ~F.col("rh").eqNullSafe(F.col("sh"))
    row = lambda df, name, key: df.select("table_key", name.alias("blocker"), key.alias("row_key"))
    no_key = F.lit(None).cast("string")
    keyed = lambda df: df.join(both.select("table_key"), "table_key").select("table_key", F.coalesce(F.col("row_key").cast("string"), F.lit("")).alias("row_key"), "pos")
    r, s = keyed(remote), keyed(source)
    # rows of all sides meet by key in one aggregate; of rows under another key the old one counts as there
    side = lambda df, **has: df.select(*KEYS, *(has.get(n, F.lit(None)).cast("int").alias(n) for n in ("r", "s", "t")), *(F.when(has[n].isNotNull(), F.col("pos")).alias(f"{n}_pos") if n in has else F.lit(None).alias(f"{n}_pos") for n in ("r", "t")))
    one = F.lit(1)
    if renamed is not None:
        names = renamed.select("table_key", F.col("current_row").cast("string").alias("row_key"), F.col("base_row").cast("string").alias("old_key"))
        taken = s.join(names, KEYS, "left").select("table_key", F.coalesce("old_key", "row_key").alias("row_key"), "pos")
        sides = [side(r, r=one), side(s, s=one), side(taken, t=one)]
    else:
        sides = [side(r, r=one), side(s, s=one, t=one)]
    count = lambda n: F.coalesce(F.sum(n), F.lit(0)).alias(n)
    keys = materialize(reduce(DataFrame.unionByName, sides).groupBy(*KEYS).agg(count("r"), count("s"), count("t"), F.min("r_pos").alias("r_pos"), F.min("t_pos").alias("pos")), "table-keys")
    issue = lambda n: F.when((F.col(n) > 0) & (F.col("row_key") == ""), "empty").when(F.col(n) > 1, "duplicate")
    faults = [row(keys.withColumn("issue", issue(n)).filter("issue IS NOT NULL"), F.concat(F.lit(f"{name}-"), "issue", F.lit("-key")), F.col("row_key")) for name, n in (("remote", "r"), ("source", "s"))]
    deleted = keys.filter("r > 0 AND t = 0")
    unsure = keys.filter((F.col("r") > 0) & (F.col("t") == 0) | issue("r").isNotNull() | issue("s").isNotNull()).select("table_key").distinct()
    pairs = keys.filter("r > 0 AND t > 0").join(unsure, "table_key", "left_anti").select(*KEYS, "r_pos", "pos")
    turned = running(pairs, ["table_key"], ["r_pos", "row_key"], lasts={"before": F.col("pos")}).filter("pos < before").select("table_key").distinct()
    return reduce(DataFrame.unionByName, [row(both.filter(differ), F.lit("headers-differ"), no_key), *faults, row(deleted, F.lit("deletes-row"), F.col("row_key")), row(turned, F.lit("reorders-rows"), no_key)])


def _matched(base: DataFrame, current: DataFrame, cells: list[str], order: str) -> DataFrame:
    """All rows (table_key, row_key, cells, in_base), each with ``partners`` (rows of its key on the other side) and, in base, ``new_key`` (of its rename).

    Both sides are shuffled once, by table; what follows stays there.
    """
    side = lambda df, flag: df.select(*KEYS, *cells, F.col(order).alias("_order"), F.lit(flag).alias("in_base"))
    rows = side(base, True).unionByName(side(current, False)).repartition("table_key")
    own = Window.partitionBy("table_key", "in_base")
    rows = rows.withColumn("_at", F.row_number().over(own.orderBy("_order", "row_key"))).withColumn("_n", F.count(F.lit(1)).over(own))
    other = F.count_if("in_base").over(Window.partitionBy(*KEYS)), F.count_if(~F.col("in_base")).over(Window.partitionBy(*KEYS))
    keyed = F.col("row_key").isNotNull() & F.col("table_key").isNotNull()
    rows = rows.withColumn("partners", F.when(keyed, F.when(F.col("in_base"), other[1]).otherwise(other[0])).otherwise(0))
    table = Window.partitionBy("table_key")
    left, row = F.col("partners") == 0, F.struct("row_key", "_at", "_n", *cells)
    of = lambda mine: F.when(F.count_if(left & mine).over(table) == 1, F.max(F.when(left & mine, row)).over(table))
    rows = rows.withColumn("_old", of(F.col("in_base"))).withColumn("_new", of(~F.col("in_base")))
    same = reduce(lambda x, y: x | y, (F.col(f"_old.{c}") == F.col(f"_new.{c}") for c in cells))
    renamed = left & F.col("in_base") & F.col("table_key").isNotNull() & (F.col("_old._n") == F.col("_new._n")) & (F.col("_old._at") == F.col("_new._at")) & same
    return rows.select(*KEYS, *cells, "in_base", "partners", F.when(renamed, F.col("_new.row_key")).alias("new_key"), F.coalesce(renamed, F.lit(False)).alias("renamed"))


def match_rows(base: DataFrame, current: DataFrame, cells: list[str], order: str = "row_key") -> DataFrame:
    """(table_key, base_row, current_row, how): equal keys, and one rename in a table.

    A rename is the single row left on both sides of tables equally long, at the same place, with a cell unchanged.
    """
    rows = _matched(base, current, cells, order).filter("in_base AND (partners > 0 OR renamed)")
    rows = rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.greatest("partners", F.lit(1)).cast("int"))))
    return rows.select("table_key", F.col("row_key").alias("base_row"), F.when(F.col("renamed"), F.col("new_key")).otherwise(F.col("row_key")).alias("current_row"), F.when(F.col("renamed"), "rename").otherwise("key").alias("how"))


def merge_field(l0: Column, l1: Column, r0: Column, r1: Column) -> tuple[Column, Column]:
    """Merged value and whether both sides changed it differently."""
    local, remote = ~l0.eqNullSafe(l1), ~r0.eqNullSafe(r1)
    conflict = local & remote & ~l1.eqNullSafe(r1)
    return F.when(local, l1).otherwise(r1), conflict


def table_merge(l0: DataFrame, l1: DataFrame, r0: DataFrame, r1: DataFrame, cells: list[str]) -> DataFrame:
    """The local change from l0 to l1 applied on r1, row by row.

    ``state``: kept (as r1 has it), updated, added, or a blocker: ``missing`` (a locally changed row that
    r0 or r1 lacks), ``deleted`` (locally deleted, still in r1), ``collision`` (a key added on both sides).
    """
    parts = [df.select(*KEYS, F.struct(*cells).alias(n)) for df, n in ((l0, "l0"), (l1, "l1"), (r0, "r0"), (r1, "r1"))]
    j = reduce(lambda a, b: a.join(b, KEYS, "full_outer"), parts)
    has = {n: F.col(n).isNotNull() for n in ("l0", "l1", "r0", "r1")}
    changed = F.array_compact(F.array(*(F.when(~F.col(f"l0.{c}").eqNullSafe(F.col(f"l1.{c}")), F.lit(c)) for c in cells)))
    state = (
        F.when(~has["l0"] & has["l1"], F.when(has["r1"], "collision").otherwise("added"))
        .when(has["l0"] & ~has["l1"], F.when(has["r1"], "deleted"))
        .when(has["l0"] & has["l1"] & (F.size(changed) > 0), F.when(has["r0"] & has["r1"], "updated").otherwise("missing"))
        .when(has["r1"], "kept")
    )
    value = lambda c: F.when(F.col("state") == "added", F.col(f"l1.{c}")).when((F.col("state") == "updated") & F.array_contains("changed", c), F.col(f"l1.{c}")).otherwise(F.col(f"r1.{c}"))
    out = j.withColumn("changed", changed).withColumn("state", state).filter("state is not null")
    return out.select(*KEYS, "state", *(value(c).alias(c) for c in cells))


def insertion_order(l1: DataFrame, r1: DataFrame) -> DataFrame:
    """(table_key, row_key, pos): r1's rows in their order, each row added in l1 behind its nearest predecessor that r1 has."""
    w = Window.partitionBy("table_key").orderBy("row_key")
    placed = lambda df, n: df.select(*KEYS, (F.row_number().over(w) - 1).alias(n))
    j = placed(l1, "at_l").join(placed(r1, "at_r"), KEYS, "full_outer")
    by_l = Window.partitionBy("table_key").orderBy(F.col("at_l").asc_nulls_last(), "row_key").rowsBetween(Window.unboundedPreceding, -1)
    behind = F.coalesce(F.last("at_r", ignorenulls=True).over(by_l), F.lit(-1))
    ranked = j.withColumn("anchor", F.coalesce("at_r", behind)).withColumn("new", F.col("at_r").isNull())
    # rows added behind one anchor keep their own order
    final = Window.partitionBy("table_key").orderBy("anchor", "new", "at_l")
    return ranked.select(*KEYS, "new", (F.row_number().over(final) - 1).alias("pos"))


def table_identity(rows: DataFrame, parts: list[str]) -> DataFrame:
    """A table's identity: its key columns' values in row order as one hash."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("row_key", *(p for p in parts if p != "row_key")))), lambda r: F.concat_ws("|", *(r[p].cast("string") for p in parts)))
    return rows.groupBy("table_key").agg(F.sha2(F.array_join(one, ";"), 256).alias("identity"), F.count(F.lit(1)).alias("rows"))


def _classes(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(table, class) of tables, and (class, identity, row_key), from rows (t, i, k): tables with the same identities and keys are one class, named by its smallest table."""
    rows = materialize(rows.repartition("t").distinct(), f"{name}-keys")
    digest = F.sha2(F.to_json(F.struct("i", "k"), {"ignoreNullFields": "false"}), 256)
    # the sum of the pairs' digests, in parts that are exact: no list of a table's rows
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)"))
    of = rows.groupBy("t").agg(F.unhex(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *(part(at).cast("string") for at in (1, 17, 33))), 256)).alias("same"))
    of = materialize(of, f"{name}-classes")
    shown = of.groupBy("same").agg(F.min("t").alias("c"))
    named = materialize(of.join(shown, "same").select("t", "c"), f"{name}-classes")
    return named, rows.join(named.filter("t = c").select("t"), "t", "left_semi").select(F.col("t").alias("c"), "i", "k")


def _met_in_classes(source: DataFrame, remote: DataFrame) -> DataFrame:
    """(t, n) of source tables that meet remote ones: classes make pairs, so copies of a table make none."""
    (sources, a), (remotes, b) = _classes(source, "source"), _classes(remote, "remote")
    b = b.select(F.col("c").alias("d"), F.col("i").alias("j"), F.col("k").alias("l"))
    met = materialize(a.join(b, (a.i == b.j) & a.k.eqNullSafe(b.l)).select("c", "d").distinct(), "classes-met")
    sizes = remotes.groupBy(F.col("c").alias("d")).agg(F.count(F.lit(1)).alias("size"))
    return sources.join(met.join(sizes, "d").groupBy("c").agg(F.sum("size").alias("n")), "c").select("t", "n")


def match_tables(source: DataFrame, remote: DataFrame, identity: str) -> DataFrame:
    """Source tables with the number of remote tables of the same identity that share a row key: 0 missing, 1 matched, more ambiguous.

    Tables of an identity with few rows on both sides meet by it, each as one row with its keys. Tables of other identities, and those that have several,
    meet row by row; with the same identities and keys they are one class there.
    A table without rows is one row with a null key; two such correspond.
    """
    side = lambda df, own: df.select(F.col("table_key").alias("t"), F.col(identity).alias("i"), F.col("row_key").alias("k"), F.lit(own).alias("own"))
    rows = side(source, True).unionByName(side(remote, False))
    sizes = materialize(rows.groupBy("own", "t", "i").agg(F.count(F.lit(1)).alias("n")), "table-sizes")
    named = sizes.filter("i IS NOT NULL AND t IS NOT NULL")
    large = named.groupBy("i").agg(F.sum("n").alias("n")).filter(F.col("n") > FEW_ROWS).select("i")
    several = named.groupBy("own", "t").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("own", "t")
    many = materialize(large.unionByName(named.join(several, ["own", "t"], "left_semi").select("i")).distinct(), "many-rows")
    rows = rows.filter("i IS NOT NULL AND t IS NOT NULL")
    any_many = not many.isEmpty()
    few = rows.join(many, "i", "left_anti") if any_many else rows
    keyed = lambda df, own, t, keys: df.filter(own).groupBy("i", F.col("t").alias(t)).agg(F.collect_set(F.struct("k")).alias(keys))
    pairs = keyed(few, F.col("own"), "t", "a").join(keyed(few, ~F.col("own"), "r", "b"), "i").filter(F.arrays_overlap("a", "b"))
    found = pairs.groupBy("i", "t").agg(F.count(F.lit(1)).alias("n")).select("t", "n")
    if any_many:
        rest = rows.join(many, "i", "left_semi")
        found = found.unionByName(_met_in_classes(*(rest.filter(own).select("t", "i", "k") for own in (F.col("own"), ~F.col("own")))))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return sizes.filter("own").select("t").distinct().join(found, "t", "left").select(F.col("t").alias("table_key"), n.alias("n"), F.when(n == 0, "missing").when(n == 1, "matched").otherwise("ambiguous").alias("state"))


def preserve_cells(source: DataFrame, remote: DataFrame, cells: list[str], same) -> DataFrame:
    """Source rows; a cell that means the same as the remote's keeps the remote's form. ``same(a, b)`` decides."""
    b = remote.select(*KEYS, *(F.col(c).alias(f"r_{c}") for c in cells), F.lit(True).alias("there"))
    j = source.join(b, KEYS, "left")
    return j.select(*KEYS, *(F.when(F.col("there") & same(F.col(c), F.col(f"r_{c}")), F.col(f"r_{c}")).otherwise(F.col(c)).alias(c) for c in cells))
