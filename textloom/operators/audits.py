"""Audits of operation logs against snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.fold import STRETCH, hash_list
from textloom.operators.ranges import numbered
from textloom.operators.trees import reached, siblings


PLACES = ("parent_id", "after_id", "before_id")


def _full(ops: DataFrame) -> DataFrame:
    """Ops with all the columns that tell a place; null where they say nothing of it."""
    return ops.select("*", *(F.lit(None).cast("string").alias(c) for c in PLACES if c not in ops.columns))


def _first_children(near: DataFrame) -> DataFrame:
    return near.filter("previous IS NULL AND parent_id IS NOT NULL").select("parent_id", F.col("block_id").alias("first"))


def validate_ops(ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Violations (op_id, op_seq, fault) of ops (op_seq, op_id, kind, target_id, expected_hash) on nodes (block_id, parent_id, pos, hash).

    Ops may name their place: parent_id, after_id (the parent itself: in front of all) and before_id. Kinds are
    replace, insert, delete and move.

    duplicate-op, inserted-twice (one new id by several ops), missing-target, target-exists (insert), hash-mismatch, root-change, missing-parent, not-a-child;
    and of anchors: missing-anchor, anchor-not-child, moving-anchor, not-adjacent (insert between two that aren't
    neighbours), same-place (a move that changes no order).
    """
    near = siblings(nodes)
    target = near.join(nodes.select("block_id", "hash"), "block_id").select(F.col("block_id").alias("target_id"), F.col("parent_id").alias("t_parent"), "hash", F.col("previous").alias("t_previous"), F.lit(True).alias("t"))
    parent = nodes.select(F.col("block_id").alias("parent_id"), F.lit(True).alias("p"))
    anchor = near.select(F.col("block_id").alias("after_id"), F.col("parent_id").alias("a_parent"), "following", F.lit(True).alias("a"))
    copies = ops.groupBy("op_id").agg(F.count(F.lit(1)).alias("copies"))
    fresh = ops.filter("kind = 'insert'").groupBy("target_id").agg(F.count(F.lit(1)).alias("inserts"))
    # hashes are compared where they first meet and go no further; joins by one column stand together
    told = _full(ops).join(fresh, "target_id", "left").join(target, "target_id", "left").withColumn("wrong", F.col("expected_hash") != F.col("hash")).drop("expected_hash", "hash")
    j = told.join(parent, "parent_id", "left").join(_first_children(near), "parent_id", "left").join(anchor, "after_id", "left").join(copies, "op_id")
    kind, has = F.col("kind"), lambda c: F.col(c).isNotNull()
    front = F.col("after_id") == F.col("parent_id")
    placed = kind.isin("insert", "move") & has("after_id")
    child = has("t") & F.col("t_parent").eqNullSafe(F.col("parent_id"))
    behind = has("a") & F.col("a_parent").eqNullSafe(F.col("parent_id"))
    following = F.when(front, F.col("first")).when(behind, F.col("following"))
    faults = F.array_compact(F.array(
        F.when(F.col("copies") > 1, "duplicate-op"),
        F.when((kind == "insert") & (F.col("inserts") > 1), "inserted-twice"),
        F.when((kind != "insert") & ~has("t"), "missing-target"),
        F.when((kind == "insert") & has("t"), "target-exists"),
        F.when((kind != "insert") & has("t") & F.col("wrong"), "hash-mismatch"),
        F.when((kind != "insert") & has("t") & ~has("t_parent"), "root-change"),
        F.when(kind.isin("insert", "delete", "move") & has("parent_id") & ~has("p"), "missing-parent"),
        F.when(kind.isin("delete", "move") & has("t") & has("p") & ~child, "not-a-child"),
        F.when(placed & ~front & ~has("a"), "missing-anchor"),
        F.when(placed & ~front & has("a") & ~behind, "anchor-not-child"),
        F.when((kind == "move") & (F.col("after_id") == F.col("target_id")), "moving-anchor"),
        F.when((kind == "insert") & has("before_id") & (front | behind) & ~F.col("before_id").eqNullSafe(following), "not-adjacent"),
        F.when((kind == "move") & child & ((front & ~has("t_previous")) | (F.col("t_previous") == F.col("after_id"))), "same-place"),
    ))
    return j.select("op_id", "op_seq", F.explode(faults).alias("fault"))


def preconditions(ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """What must hold before each op, as rows (op_id, op_seq, what, target_id, wanted), taken from the nodes that it was planned on.

    exists, hash; parent (of what is deleted or moved); and of a place that something goes to, next (what follows the
    anchor, empty at the end) or first (the parent's first child).
    """
    near = siblings(nodes)
    anchor = near.select(F.col("block_id").alias("after_id"), F.coalesce("following", F.lit("")).alias("following"))
    j = _full(ops).join(anchor, "after_id", "left").join(_first_children(near), "parent_id", "left")
    row = lambda what, target, wanted: F.struct(F.lit(what).alias("what"), F.col(target).alias("target_id"), wanted.cast("string").alias("wanted"))
    old, placed = F.col("kind") != "insert", F.col("kind").isin("insert", "move")
    front = F.col("after_id") == F.col("parent_id")
    rows = F.array_compact(F.array(
        F.when(old, row("exists", "target_id", F.lit("true"))),
        F.when(old & F.col("expected_hash").isNotNull(), row("hash", "target_id", F.col("expected_hash"))),
        F.when(F.col("kind").isin("delete", "move") & F.col("parent_id").isNotNull(), row("parent", "target_id", F.col("parent_id"))),
        F.when(placed & front, row("first", "parent_id", F.coalesce("first", F.lit("")))),
        F.when(placed & ~front, row("next", "after_id", F.coalesce("following", F.lit("")))),
    ))
    return j.select("op_id", "op_seq", F.explode(rows).alias("r")).select("op_id", "op_seq", "r.target_id", "r.what", "r.wanted")


def check_preconditions(conditions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Conditions with ``holds`` on a snapshot, which may be another than the planned one."""
    near = siblings(nodes)
    facts = near.join(nodes.select("block_id", "hash"), "block_id").join(_first_children(near).withColumnRenamed("parent_id", "block_id"), "block_id", "left")
    facts = facts.select(F.col("block_id").alias("target_id"), "parent_id", "hash", "first", "following", F.lit(True).alias("found"))
    j = conditions.join(facts, "target_id", "left")
    what, actual = F.col("what"), F.lit("true")
    for name, value in {"hash": F.col("hash"), "parent": F.col("parent_id"), "first": F.coalesce("first", F.lit("")), "next": F.coalesce("following", F.lit(""))}.items():
        actual = F.when(what == name, value).otherwise(actual)
    return j.select("op_id", "op_seq", "target_id", "what", (F.col("found").isNotNull() & actual.eqNullSafe(F.col("wanted"))).alias("holds"))


def op_tokens(ops: DataFrame, by: str) -> DataFrame:
    """Per batch a fingerprint of its ops' tokens in order; a token is the hash of what the op says.

    Tokens are hashed in stretches, and the stretches' hashes once more, so that a long batch is no list of all its tokens.
    """
    token = F.sha2(F.concat_ws("|", F.col("op_seq").cast("string"), "kind", "target_id", F.coalesce("expected_hash", F.lit(""))), 256)
    rows = numbered(ops.select(by, "op_seq", "op_id", token.alias("t")), [by], ["op_seq", "op_id"], "at").withColumn("stretch", F.floor(F.col("at") / STRETCH))
    in_order = lambda at: hash_list(F.transform(F.array_sort(F.collect_list(F.struct(at, "t"))), lambda x: x["t"]))
    parts = rows.groupBy(by, "stretch").agg(in_order("at").alias("t"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(by).agg(in_order("stretch").alias("fingerprint"), F.sum("n").alias("n_ops"))


def unplanned_changes(before: DataFrame, after: DataFrame, ops: DataFrame) -> DataFrame:
    """Blocks that changed although neither they nor anything above them was an op's target: (block_id, change)."""
    a, b = (df.select("block_id", F.col("hash").alias(n), F.lit(True).alias(f"in_{n}")) for df, n in ((before, "was"), (after, "now")))
    change = F.when(F.col("in_was").isNull(), "added").when(F.col("in_now").isNull(), "removed").when(F.col("was") != F.col("now"), "updated")
    changed = a.join(b, "block_id", "full_outer").select("block_id", change.alias("change")).filter("change IS NOT NULL")
    tops = ops.select(F.col("target_id").alias("block_id")).distinct()
    allowed = reached(before.unionByName(after).select("block_id", "parent_id").distinct(), tops)
    return changed.join(allowed, "block_id", "left_anti")


def check_readback(ops: DataFrame, after: DataFrame) -> DataFrame:
    """Ops with ``done``: a deleted block is gone, any other target is there; what was moved or inserted stands behind its anchor, or in front of all."""
    now = siblings(after).select(F.col("block_id").alias("target_id"), F.col("parent_id").alias("now_parent"), "previous", F.lit(True).alias("there"))
    j = _full(ops).join(now, "target_id", "left")
    there = F.col("there").isNotNull()
    behind = F.coalesce("previous", "now_parent").eqNullSafe(F.col("after_id"))
    placed = F.col("kind").isin("insert", "move") & F.col("after_id").isNotNull()
    return j.select("op_id", "op_seq", F.when(F.col("kind") == "delete", ~there).when(placed, there & behind).otherwise(there).alias("done"))


def resume_report(batches: DataFrame, log: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Per batch: state (done, resume, manual), why, and the number of pending ops.

    A batch resumes if its completed ops are a prefix of it and the document still is what the log left: ``states``
    (batch, recorded, current) are hashes of both, and a batch without a recorded one can't have changed.
    """
    j = batches.join(log.select("op_id", F.lit(True).alias("ran")).distinct(), "op_id", "left").withColumn("ran", F.coalesce("ran", F.lit(False)))
    first_open = F.min(F.when(~F.col("ran"), F.col("op_seq")))
    last_ran = F.max(F.when(F.col("ran"), F.col("op_seq")))
    r = j.groupBy("batch").agg(F.count_if(~F.col("ran")).alias("pending"), first_open.alias("first_open"), last_ran.alias("last_ran"))
    if states is None:
        r = r.withColumn("moved", F.lit(False))
    else:
        moved = states.filter("recorded IS NOT NULL AND NOT recorded <=> current").select("batch", F.lit(True).alias("moved")).distinct()
        r = r.join(moved, "batch", "left").withColumn("moved", F.coalesce("moved", F.lit(False)))
    prefix = F.coalesce(F.col("last_ran") < F.col("first_open"), F.lit(True))
    why = F.when(F.col("moved"), "document-changed").when(F.col("pending") == 0, "complete").when(prefix, "prefix").otherwise("out-of-order")
    state = F.when(why == "complete", "done").when(why == "prefix", "resume").otherwise("manual")
    return r.select("batch", "pending", state.alias("state"), why.alias("why"))


def phase_order(ops: DataFrame, phases: dict[str, list[int]]) -> DataFrame:
    """Ops in order of execution phases; a kind with two phases stands twice. (batch, op_id, phase, position)."""
    listed = F.array().cast("array<int>")
    for kind, numbers in phases.items():
        listed = F.when(F.col("kind") == kind, F.array(*(F.lit(n) for n in numbers))).otherwise(listed)
    rows = ops.select("batch", "op_id", "op_seq", F.explode(listed).alias("phase"))
    return numbered(rows, ["batch"], ["phase", "op_seq", "op_id"], "position").drop("op_seq")


def first_blocker(diagnostics: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first blocker of each document, as an aggregate."""
    return diagnostics.groupBy(*keys).agg(F.min(F.struct(*order)).alias("b")).select(*keys, *(F.col(f"b.{c}").alias(c) for c in order))


def plan_flags(ops: DataFrame, key: str) -> DataFrame:
    """Per document: safe (no blocker), risky (a remote change under an op), needs_confirmation."""
    return ops.groupBy(key).agg(F.bool_and(~F.col("blocked")).alias("safe"), F.bool_or("remote_changed").alias("risky"), F.bool_or(~F.col("tracked")).alias("needs_confirmation"))


def surplus_copies(remote: DataFrame, desired: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Remote rows beyond the number of desired copies of their fingerprint, latest first to go."""
    n = desired.groupBy(*keys).agg(F.count(F.lit(1)).alias("wanted"))
    return numbered(remote, keys, [order], "copy").join(n, keys, "left").filter(F.col("copy") >= F.coalesce("wanted", F.lit(0))).select(*remote.columns)


def missing_tracked(receipts: DataFrame, local: DataFrame, keys: list[str]) -> DataFrame:
    return receipts.join(local.select(*keys).distinct(), keys, "left_anti")


def outside_hash(nodes: DataFrame, scopes: DataFrame, group: str, section: str, order: str, value: str) -> DataFrame:
    """Per document a hash of all nodes outside the named sections, in order."""
    kept = nodes.join(scopes.select(group, section).distinct(), [group, section], "left_anti")
    return kept.groupBy(group).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), ","), 256).alias("hash"))


def assign_once(desired: DataFrame, remote: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Desired rows with the remote id they take: equal keys first, then a value unique on both sides among the rest. Ids are used once."""
    exact = desired.join(remote, keys).select(*keys, "remote_id", F.lit("locator").alias("how"))
    rest_d = desired.join(exact.select(*keys), keys, "left_anti")
    rest_r = remote.join(exact.select("remote_id"), "remote_id", "left_anti")
    one = lambda df: df.join(df.groupBy(value).count().filter("count = 1").select(value), value)
    second = one(rest_d).join(one(rest_r).select(value, "remote_id"), value).select(*keys, "remote_id", F.lit("unique").alias("how"))
    taken = exact.unionByName(second)
    return desired.select(*keys).join(taken, keys, "left").select(*keys, "remote_id", F.coalesce("how", F.lit("create")).alias("how"))
