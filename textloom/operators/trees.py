"""Block trees: validation, order, hashes, children, descendants.

A tree is rows of (block_id, parent_id, payload, pos). Levels are walked by joins, one per depth, each
written before the next, until one is empty. A walk from the roots ends by itself: a block that lies on its
own path (a cycle) isn't walked again.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import materialize


def levels(blocks: DataFrame) -> DataFrame:
    """Blocks reached from roots, with depth and a path key whose byte order is pre-order."""
    step = lambda: F.lpad(F.col("pos").cast("string"), 12, "0")
    level = blocks.filter("parent_id IS NULL").select("block_id", "parent_id", F.lit(0).alias("depth"), F.concat(step(), F.lit(":"), "block_id").alias("path"))
    below, parts, depth = blocks.filter("parent_id IS NOT NULL"), [level], 0
    while True:
        depth += 1
        up = level.select(F.col("block_id").alias("up"), F.col("path").alias("up_path"))
        walked = F.concat(F.lit("/"), F.col("up_path"), F.lit("/"))
        # a block that lies on its own path closes a cycle
        found = below.join(up, F.col("parent_id") == F.col("up")).filter(~F.contains(walked, F.concat(F.lit(":"), "block_id", F.lit("/"))))
        level = materialize(found.select("block_id", "parent_id", F.lit(depth).alias("depth"), F.concat("up_path", F.lit("/"), step(), F.lit(":"), "block_id").alias("path")), "tree-level")
        if level.isEmpty():
            break
        parts.append(level)
        if len(parts) == 64:  # one table of the levels so far keeps the plan small
            parts = [materialize(reduce(DataFrame.unionByName, parts), "tree-levels")]
    return reduce(DataFrame.unionByName, parts)


def preorder(blocks: DataFrame) -> DataFrame:
    """block_id, depth, n: pre-order number over all trees, by a range sort and counts per range, not by one task."""
    walked = levels(blocks).select("block_id", "depth", "path")
    parts = materialize(walked.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()).withColumn("in_part", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)), "preorder")
    # one number per partition of the sort: as many as there are tasks
    counts = sorted((r["part"], r["n"]) for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts = list(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0)))
    before = blocks.sparkSession.createDataFrame(starts, "part int, before long")
    return parts.join(F.broadcast(before), "part").select("block_id", "depth", (F.col("before") + F.col("in_part")).alias("n"))


def siblings(blocks: DataFrame) -> DataFrame:
    """block_id, parent_id, ordinal, previous, following: each block's place among the blocks of its parent, by (pos, block_id).

    Blocks are sorted by range and numbered inside each range; a parent with children in several ranges needs one row
    for each of them to go on from one to the next. So one parent's children needn't fit one task.
    """
    keys = ["parent_id", "pos", "block_id"]
    parts = materialize(blocks.select(*keys).repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "siblings")
    inside = Window.partitionBy("part", "parent_id").orderBy("pos", "block_id")
    placed = parts.select("part", "parent_id", "block_id", (F.row_number().over(inside) - 1).alias("at"), F.lag("block_id").over(inside).alias("before"), F.lead("block_id").over(inside).alias("after"))
    place = F.struct("pos", "block_id")
    runs = parts.groupBy("part", "parent_id").agg(F.min_by("block_id", place).alias("first"), F.max_by("block_id", place).alias("last"), F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("parent_id").orderBy("part")  # as many rows as the sort has ranges, at most
    start = F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", F.col("parent_id").alias("p"), start.alias("start"), F.lag("last").over(over).alias("run_before"), F.lead("first").over(over).alias("run_after"))
    j = placed.join(runs, (placed.part == runs.part) & F.col("parent_id").eqNullSafe(F.col("p")))
    return j.select("block_id", "parent_id", (F.col("start") + F.col("at")).alias("ordinal"), F.coalesce("before", "run_before").alias("previous"), F.coalesce("after", "run_after").alias("following"))


def validate_snapshot(blocks: DataFrame, refs: DataFrame | None = None, snapshot: str | None = None) -> DataFrame:
    """Faults of a snapshot as rows (block_id, fault), each once.

    ``blocks`` declare their parent (null: a root); ``refs`` (parent_id, child_id) are the children that blocks list.
    Without them the declared parents are the references.

    duplicate-id; missing-parent (declared, not there); missing-child, duplicate-child (of the block that lists it);
    conflicting-parents (listed by several blocks); root-referenced; unreferenced (no root, in no list);
    parent-disagrees (declared and listing block differ); unreachable (orphans below those, or cycles);
    several-roots (each of them), no-root (a row without a block): a snapshot has exactly one. ``snapshot`` names the column that tells
    those of ``blocks`` apart, where there are several; ids differ between them. An empty table has no faults.
    """
    if refs is None:
        refs = blocks.filter("parent_id IS NOT NULL").select("parent_id", F.col("block_id").alias("child_id")).distinct()
    # each table of ids is written once: what follows joins two of them at a time, and no stage sorts more
    ids = materialize(blocks.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("parent_id").isNull()).alias("root")), "snapshot-ids")
    parents = ids.select(F.col("block_id").alias("parent_id"))
    listed = materialize(refs.groupBy("parent_id", "child_id").agg(F.count(F.lit(1)).alias("n")).join(parents, "parent_id", "left_semi"), "listed-children")
    listed = materialize(listed.join(ids.select(F.col("block_id").alias("child_id"), F.col("root").alias("child_root")), "child_id", "left"), "listed-children")
    there = listed.filter("child_root IS NOT NULL").select("parent_id", F.col("child_id").alias("block_id"), "child_root")
    by = there.groupBy("block_id").agg(F.count(F.lit(1)).alias("parents"), F.min("parent_id").alias("lister"))
    placed = materialize(ids.join(by, "block_id", "left"), "listed-blocks")
    of = [F.col(snapshot)] if snapshot else []
    per_snapshot = materialize(blocks.groupBy(*of).agg(F.count_distinct(F.when(F.col("parent_id").isNull(), F.col("block_id"))).alias("roots"), F.count(F.lit(1)).alias("blocks")).filter("blocks > 0"), "root-counts")
    crowded, roots = per_snapshot.filter("roots > 1"), ids.filter("root").select("block_id")
    if snapshot:
        several = blocks.filter("parent_id IS NULL").join(crowded, snapshot, "left_semi")
    else:
        several = roots if not crowded.isEmpty() else roots.limit(0)
    found = reached(there.filter("NOT child_root").select("block_id", "parent_id"), roots)
    declared = materialize(blocks.filter("parent_id IS NOT NULL").select("block_id", "parent_id").distinct().join(placed.select("block_id", "parents", "lister"), "block_id", "left"), "declared-parents")
    fault = lambda test, name: F.when(test, F.lit(name))
    told = lambda df, c, *faults: df.select(F.col(c).alias("block_id"), F.explode(F.array_compact(F.array(*faults))).alias("fault"))
    listers = F.col("parents")
    return reduce(DataFrame.unionByName, [
        told(placed, "block_id", fault(F.col("n") > 1, "duplicate-id"), fault(listers > 1, "conflicting-parents"), fault(F.col("root") & (listers > 0), "root-referenced")),
        told(declared, "block_id", fault(listers.isNull(), "unreferenced"), fault((listers == 1) & (F.col("lister") != F.col("parent_id")), "parent-disagrees")),
        told(declared.join(parents, "parent_id", "left_anti"), "block_id", F.lit("missing-parent")),
        told(listed, "parent_id", fault(F.col("child_root").isNull(), "missing-child"), fault(F.col("n") > 1, "duplicate-child")),
        told(ids.join(found, "block_id", "left_anti"), "block_id", F.lit("unreachable")),
        told(several, "block_id", F.lit("several-roots")),
        per_snapshot.filter("roots = 0").select(F.lit(None).cast(blocks.schema["block_id"].dataType).alias("block_id"), F.lit("no-root").alias("fault")),
    ]).distinct()


def flatten_snapshot(blocks: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """block_id, parent_id, depth, kind, node_hash, n_children."""
    kind = F.lit("other")
    for prefix, name in kinds.items():
        kind = F.when(F.startswith("block_id", F.lit(prefix)), name).otherwise(kind)
    walked = levels(blocks).select("block_id", "depth")
    children = blocks.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("block_id")).agg(F.count(F.lit(1)).alias("n_children"))
    j = blocks.join(walked, "block_id").join(children, "block_id", "left")
    return j.select("block_id", "parent_id", "depth", kind.alias("kind"), F.sha2(F.concat_ws("|", "block_id", "payload"), 256).alias("node_hash"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


def snapshot_hash(blocks: DataFrame, group: str) -> DataFrame:
    """Per parent, a hash over its children's hashes in order."""
    node = F.sha2(F.concat_ws("|", "block_id", "payload"), 256)
    return blocks.filter(F.col(group).isNotNull()).groupBy(group).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block_id", node.alias("h")))), lambda x: x["h"]), ","), 256).alias("hash"), F.count(F.lit(1)).alias("n"))


def resolve_children(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """References (parent_id, ordinal, child_id) with the child's payload; a missing child is marked."""
    child = blocks.select(F.col("block_id").alias("child_id"), "payload", F.lit(True).alias("found"))
    return refs.join(child, "child_id", "left").select("parent_id", "ordinal", "child_id", "payload", F.coalesce("found", F.lit(False)).alias("found"))


def descendants(blocks: DataFrame, tops: DataFrame) -> DataFrame:
    """(top, block_id) of everything at or below the given blocks; each pair once, so that a cycle ends too."""
    level = materialize(tops.select(F.col("block_id").alias("top"), "block_id").distinct(), "descendants")
    done, rounds = level, 0
    while not level.isEmpty():
        below = blocks.select("block_id", "parent_id").join(level.select("top", F.col("block_id").alias("parent_id")), "parent_id").select("top", "block_id").distinct()
        level = materialize(below.join(done, ["top", "block_id"], "left_anti"), "descendants")
        done, rounds = done.unionByName(level), rounds + 1
        if rounds % 16 == 0:
            done = materialize(done, "descendants")
    return done


def reached(blocks: DataFrame, tops: DataFrame) -> DataFrame:
    """(block_id) of everything at or below any of the given blocks, once each, however many of them stand above."""
    level = materialize(tops.select("block_id").distinct(), "reached")
    done, rounds = level, 0
    while not level.isEmpty():
        below = blocks.select("block_id", "parent_id").join(level.select(F.col("block_id").alias("parent_id")), "parent_id", "left_semi").select("block_id").distinct()
        level = materialize(below.join(done, "block_id", "left_anti"), "reached")
        done, rounds = done.unionByName(level), rounds + 1
        if rounds % 16 == 0:
            done = materialize(done, "reached")
    return done


def ordered_children(blocks: DataFrame) -> DataFrame:
    """block_id, parent_id and the number among siblings."""
    return siblings(blocks).select("block_id", "parent_id", "ordinal")
