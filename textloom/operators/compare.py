"""Keyed comparison of versions: what changed, what corresponds, what is ambiguous."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.runtime import materialize


def _on(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def changed_nodes(base: DataFrame, current: DataFrame, keys: list[str], value: str = "hash") -> DataFrame:
    """Keys with ``change``: added, removed or updated; unchanged keys are left out."""
    a, b = (df.select(*keys, F.col(value).alias(name), F.lit(True).alias(f"in_{name}")) for df, name in ((base, "before"), (current, "after")))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "updated")
    return both.select(*keys, "before", "after", change.alias("change")).filter("change is not null")


def all_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).union(b.select(*keys)).distinct()


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def two_sided_changes(base: DataFrame, local: DataFrame, remote: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with ``local`` and ``remote``: whether that side added, removed or updated them. All three versions meet behind one shuffle."""
    sides = (base, local, remote)
    rows = reduce(DataFrame.unionByName, (df.select(*keys, F.lit(i).cast("byte").alias("_side"), F.col(value).alias("_v")) for i, df in enumerate(sides)))
    of = lambda i, c: F.when(F.col("_side") == i, c)
    seen = [f(of(i, c)).alias(f"_{name}{i}") for i in range(3) for name, f, c in (("min", F.min, F.col("_v")), ("max", F.max, F.col("_v")), ("n", F.count, F.lit(1)), ("known", F.count, F.col("_v")))]
    met = rows.repartition(*keys).groupBy(*keys).agg(*seen)
    low, high, n, known = (lambda i, name=name: F.col(f"_{name}{i}") for name in ("min", "max", "n", "known"))
    one = lambda i: low(i).eqNullSafe(high(i)) & ((known(i) == 0) | (known(i) == n(i)))  # noqa: E731  a key that stands there twice is the same only with one value
    same = lambda i: ((n(0) == 0) & (n(i) == 0)) | ((n(0) > 0) & (n(i) > 0) & one(0) & one(i) & low(0).eqNullSafe(low(i)))
    return met.select(*keys, (~same(1)).alias("local"), (~same(2)).alias("remote"))


def unrelated_changes(base: DataFrame, local: DataFrame, remote: DataFrame, keys: list[str], value: str = "hash") -> DataFrame:
    """Keys changed remotely and not locally."""
    return two_sided_changes(base, local, remote, keys, value).filter("remote AND NOT local").select(*keys)


def correspond_nodes(base: DataFrame, current: DataFrame, group: list[str], key: str, value: str, order: str = "pos") -> DataFrame:
    """Pairs (group, base_key, current_key, how), found in two passes.

    First values that occur once on both sides of a group; of the rest, equal keys. A value whose number
    of copies differs on the two sides is ambiguous, and its rows are reported so instead of being paired.
    """
    # texts are hashed where they lie; each side is read once
    text = isinstance(base.schema[value].dataType, StringType) and isinstance(current.schema[value].dataType, StringType)
    said = F.unhex(F.sha2(value, 256)) if text else F.col(value)
    known = reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in (*group, value)))
    side = lambda df, name: df.filter(known).select(*group, said.alias("_said"), F.col(key).alias(f"{name}_key"), F.lit(name == "base").alias("_base"))
    rows = materialize(side(base, "base").unionByName(side(current, "current"), allowMissingColumns=True), "said")
    met = rows.groupBy(*group, "_said").agg(F.count_if("_base").alias("_n"), F.count_if(~F.col("_base")).alias("_m"), F.min("current_key").alias("_other"))
    once, uneven = (F.col("_n") == 1) & (F.col("_m") == 1), (F.col("_n") > 0) & (F.col("_m") > 0) & (F.col("_n") != F.col("_m"))
    placed = rows.join(met, [*group, "_said"]).select(*group, "_base", "base_key", F.when(once, F.col("_other")).otherwise(F.col("current_key")).alias("current_key"), once.alias("_once"), uneven.alias("uneven"))
    placed = materialize(placed.filter("_base OR NOT _once"), "met")
    first = placed.filter("_once").select(*group, "base_key", "current_key", F.lit("value").alias("how"))
    rest_a = placed.filter("_base AND NOT _once").select(*group, "base_key", "uneven").join(first.select(*group, "base_key"), [*group, "base_key"], "left_anti")
    rest_b = placed.filter("NOT _base").select(*group, "current_key").join(first.select(*group, "current_key"), [*group, "current_key"], "left_anti")
    second = rest_a.join(rest_b.withColumn("base_key", F.col("current_key")), [*group, "base_key"])
    return first.unionByName(second.select(*group, "base_key", "current_key", F.when(F.col("uneven"), "ambiguous").otherwise("key").alias("how")))


def positional_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Line by line at the same number, without alignment: (doc_id, line_no, mark, line)."""
    j = left.select("doc_id", "line_no", F.col("line").alias("a")).join(right.select("doc_id", "line_no", F.col("line").alias("b")), ["doc_id", "line_no"], "full_outer")
    row = lambda mark, c: F.struct(F.lit(mark).alias("mark"), F.col(c).alias("line"))
    rows = F.when(F.col("a") == F.col("b"), F.array(row(" ", "a"))).otherwise(F.filter(F.array(row("-", "a"), row("+", "b")), lambda r: r["line"].isNotNull()))
    return j.select("doc_id", "line_no", F.explode(rows).alias("r")).select("doc_id", "line_no", "r.mark", "r.line")


def divergence(local: DataFrame, remote: DataFrame, keys: list[str], value: str, by: list[str]) -> DataFrame:
    """Per group: matching, changed, local_only, remote_only."""
    a, b = (df.select(*keys, F.col(value).alias(n), F.lit(True).alias(f"in_{n}")) for df, n in ((local, "a"), (remote, "b")))
    j = a.join(b, keys, "full_outer")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    same = F.col("a").eqNullSafe(F.col("b"))
    return j.groupBy(*by).agg(F.count_if(both & same).alias("matching"), F.count_if(both & ~same).alias("changed"), F.count_if(F.col("in_b").isNull()).alias("local_only"), F.count_if(F.col("in_a").isNull()).alias("remote_only"))


def scope_summary(base: DataFrame, local: DataFrame, remote: DataFrame, group: list[str], key: str, value: str = "hash") -> DataFrame:
    """Per group with a change: how many keys changed locally, remotely, on both, and remotely only."""
    j = two_sided_changes(base, local, remote, [*group, key], value).filter("local OR remote")
    l, r = F.col("local"), F.col("remote")  # noqa: E741
    return j.groupBy(*group).agg(F.count_if(l).alias("local_changed"), F.count_if(r).alias("remote_changed"), F.count_if(l & r).alias("overlapping"), F.count_if(r & ~l).alias("unrelated"))


def common_prefix(a: DataFrame, b: DataFrame, group: list[str], value: str, pos: str) -> DataFrame:
    """Per group the number of leading rows that are equal at equal positions (0-based ``pos``)."""
    j = a.select(*group, pos, F.col(value).alias("a"), F.lit(1).alias("ia")).join(b.select(*group, pos, F.col(value).alias("b"), F.lit(1).alias("ib")), [*group, pos], "full_outer")
    differs = F.col("ia").isNull() | F.col("ib").isNull() | ~F.col("a").eqNullSafe(F.col("b"))
    return j.groupBy(*group).agg(F.coalesce(F.min(F.when(differs, F.col(pos))), F.max(pos) + 1).cast("long").alias("prefix"))


def common_suffix(a: DataFrame, b: DataFrame, group: list[str], value: str, pos: str) -> DataFrame:
    """Per group the number of equal trailing rows that aren't in the common prefix; with ``prefix``."""
    w = Window.partitionBy(*group)
    turned = lambda df: df.withColumn("n", F.max(pos).over(w) + 1).withColumn("back", F.col("n") - 1 - F.col(pos)).select(*group, "back", value, "n")
    ra, rb = turned(a), turned(b)
    tail = common_prefix(ra.withColumnRenamed("back", pos).drop("n"), rb.withColumnRenamed("back", pos).drop("n"), group, value, pos).withColumnRenamed("prefix", "tail")
    n = ra.groupBy(*group).agg(F.max("n").alias("na")).join(rb.groupBy(*group).agg(F.max("n").alias("nb")), group, "full_outer")
    j = common_prefix(a, b, group, value, pos).join(tail, group).join(n, group)
    room = F.least(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))) - F.col("prefix")
    return j.select(*group, "prefix", F.least(F.col("tail"), room).cast("long").alias("suffix"))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, all columns. One aggregation, so a key with very many rows isn't one task's."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``occ``: 1-based number among the rows of a key."""
    return df.withColumn("occ", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def order_preserved(pairs: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Per group: whether matched rows stand in the same order on both sides."""
    w = Window.partitionBy(*group).orderBy(a)
    rising = F.coalesce(F.col(b) > F.lag(b).over(w), F.lit(True))
    return pairs.withColumn("rising", rising).groupBy(*group).agg(F.bool_and("rising").alias("preserved"))


def pair_depth(tokens: DataFrame, group: list[str], order: str, step: Column) -> DataFrame:
    """Tokens with running ``depth``; per group whether they pair and never nest."""
    w = Window.partitionBy(*group).orderBy(order)
    deep = tokens.withColumn("step", step).withColumn("depth", F.sum("step").over(w))
    return deep.groupBy(*group).agg(F.max("depth").alias("deepest"), F.min("depth").alias("lowest"), F.sum("step").alias("open"), ((F.max("depth") <= 1) & (F.min("depth") >= 0) & (F.sum("step") == 0)).alias("paired"))


def neighbours(df: DataFrame, group: list[str], order: str, value: str, skip: Column) -> DataFrame:
    """``previous`` and ``following`` value, passing over rows that are to be skipped."""
    seen = F.when(~skip, F.col(value))
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("previous", F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("following", F.first(seen, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def placement_key(df: DataFrame, group: list[str], section: str, order: str, value: str) -> DataFrame:
    """``placement``: hash of section and predecessor, by which a node's place is recognised."""
    w = Window.partitionBy(*group, section).orderBy(order)
    return df.withColumn("placement", F.sha2(F.concat_ws("|", section, F.coalesce(F.lag(value).over(w), F.lit("^"))), 256))
