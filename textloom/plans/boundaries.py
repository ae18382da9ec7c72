"""Plans for pairs of boundary tokens (``<Steps>`` ... ``</Steps>``) as units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.lines import fold
from textloom.operators.ranges import running
from textloom.runtime import materialize

TOKEN = "authoring-token"


def token_pairs(nodes: DataFrame) -> DataFrame:
    """(doc_id, open_pos, close_pos): tokens matched by a stack, innermost first; a token without its other has null in its place."""
    tokens = nodes.filter(F.col("kind") == TOKEN).select("doc_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("value", r"^</?(\w+)", 1).alias("name"), F.startswith("value", F.lit("</")).alias("closing"))
    rows = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "closing"))).alias("t"))
    none, no_pos = F.array().cast("array<struct<open_pos:bigint,close_pos:bigint>>"), F.lit(None).cast("long")
    pair = lambda a, b: F.array(F.struct(a.alias("open_pos"), b.alias("close_pos")))

    def step(stack: Column, x: Column) -> tuple[Column, Column]:
        top = F.try_element_at(stack, F.lit(-1))
        fits = F.coalesce(top["name"] == x["name"], F.lit(False))
        popped = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        pushed = F.concat(stack, F.array(F.struct(x["pos"].alias("pos"), x["name"].alias("name"))))
        return F.when(~x["closing"], pushed).when(fits, popped).otherwise(stack), F.when(~x["closing"], none).when(fits, pair(top["pos"], x["pos"])).otherwise(pair(no_pos, x["pos"]))

    found = fold(F.col("t"), F.array().cast("array<struct<pos:bigint,name:string>>"), "struct<open_pos:bigint,close_pos:bigint>", step, lambda stack: F.transform(stack, lambda s: F.struct(s["pos"].alias("open_pos"), no_pos.alias("close_pos"))))
    return rows.select("doc_id", F.explode(found).alias("p")).select("doc_id", "p.*")


def _anchored(nodes: DataFrame) -> DataFrame:
    """Tokens with ``anchor``: the node before them that is no token."""
    own = F.when(F.col("kind") != TOKEN, F.col("locator"))
    return running(nodes, ["doc_id"], ["pos", "locator"], lasts={"anchor": own}).filter(F.col("kind") == TOKEN)


def boundary_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(doc_id, token, local_locator, remote_locator, op, after, blocker) that give the remote document the local one's boundaries.

    Nodes are (doc_id, pos, section, kind, locator, value). A token stands behind the node before it; that node must be on the remote side once, in the
    same section, with the same value. There it stays, comes from elsewhere in the section (move), or is new (create); remote tokens left over are deleted. A pair
    is one unit: what blocks one of its tokens (anchor-missing, boundary-ambiguous) blocks the other (pair-blocked). Unpaired local tokens
    block, and so do remote ones where the local document has none.
    """
    lt, rt = materialize(_anchored(local), "local-tokens"), materialize(_anchored(remote), "remote-tokens")
    pairs = materialize(token_pairs(local), "local-pairs")
    ends = lambda df: df.select("doc_id", F.coalesce("open_pos", "close_pos").alias("pair"), (F.col("open_pos").isNotNull() & F.col("close_pos").isNotNull()).alias("whole"), F.explode(F.array_compact(F.array("open_pos", "close_pos"))).alias("pos"))
    lt = lt.join(ends(pairs), ["doc_id", "pos"])
    # the remote node that is a local token's anchor
    texts = lambda df: df.filter(F.col("kind") != TOKEN)
    known = texts(local).select("doc_id", F.col("locator").alias("anchor"), F.col("section").alias("a_section"), F.col("value").alias("a_value"))
    there = texts(remote).groupBy("doc_id", F.col("section").alias("a_section"), F.col("value").alias("a_value")).agg(F.count(F.lit(1)).alias("n"), F.min("locator").alias("remote_anchor"))
    wanted = lt.join(known, ["doc_id", "anchor"], "left").join(there, ["doc_id", "a_section", "a_value"], "left")
    against = F.when(~F.col("whole"), "boundary-ambiguous").when(F.col("anchor").isNull() | F.col("n").isNull(), "anchor-missing").when(F.col("n") > 1, "boundary-ambiguous")
    wanted = materialize(wanted.select("doc_id", F.col("locator").alias("local_locator"), "pos", "section", "value", "pair", "remote_anchor", against.alias("blocker")), "wanted-tokens")
    fine = wanted.filter("blocker IS NULL")
    r = rt.select("doc_id", F.col("locator").alias("remote_locator"), "section", "value", F.col("anchor").alias("remote_anchor"))
    at = ["doc_id", "section", "value", "remote_anchor"]
    here = r.groupBy(*at).agg(F.count(F.lit(1)).alias("here"), F.min("remote_locator").alias("remote_locator"))
    asked = fine.groupBy(*at).agg(F.count(F.lit(1)).alias("asked"))
    exact = materialize(fine.join(here, at).join(asked, at), "exact-tokens")
    stays = exact.filter("here = 1 AND asked = 1")
    rest = fine.join(exact.select("doc_id", "local_locator"), ["doc_id", "local_locator"], "left_anti")
    free = materialize(r.join(stays.select("doc_id", "remote_locator"), ["doc_id", "remote_locator"], "left_anti"), "free-tokens")
    kind = ["doc_id", "section", "value"]
    supply = free.groupBy(*kind).agg(F.count(F.lit(1)).alias("free"), F.min("remote_locator").alias("remote_locator")).join(rest.groupBy(*kind).agg(F.count(F.lit(1)).alias("need")), kind)
    placed = rest.join(supply, kind, "left")
    unclear = F.coalesce((F.col("free") > 1) | (F.col("need") > 1), F.lit(False))
    none = F.lit(None).cast("string")
    row = lambda df, op, target, blocker: df.select("doc_id", "pair", F.col("value").alias("token"), "local_locator", target.alias("remote_locator"), op.alias("op"), F.col("remote_anchor").alias("after"), blocker.alias("blocker"))
    mine = reduce(DataFrame.unionByName, [
        row(wanted.filter("blocker IS NOT NULL"), none, none, F.col("blocker")), row(stays, F.lit("keep"), F.col("remote_locator"), none), row(exact.filter("here > 1 OR asked > 1"), none, none, F.lit("boundary-ambiguous")),
        row(placed.filter(unclear), none, none, F.lit("boundary-ambiguous")), row(placed.filter(~unclear & F.col("free").isNull()), F.lit("create"), none, none), row(placed.filter(~unclear & (F.col("free") == 1)), F.lit("move"), F.col("remote_locator"), none),
    ])
    mine = materialize(mine, "token-ops")
    blocked = mine.groupBy("doc_id", "pair").agg(F.bool_or(F.col("blocker").isNotNull()).alias("stuck"))
    mine = mine.join(blocked, ["doc_id", "pair"]).withColumn("blocker", F.coalesce("blocker", F.when(F.col("stuck"), "pair-blocked"))).withColumn("op", F.when(F.col("blocker").isNull(), F.col("op"))).withColumn("after", F.when(F.col("blocker").isNull(), F.col("after")))
    taken = mine.filter("op IN ('keep', 'move')").select("doc_id", "remote_locator")
    calm = mine.groupBy("doc_id").agg(F.count("blocker").alias("b"))  # of documents with local tokens
    left = r.join(taken, ["doc_id", "remote_locator"], "left_anti").join(calm, "doc_id", "left").filter("coalesce(b, 0) = 0")
    broken = token_pairs(remote).filter("open_pos IS NULL OR close_pos IS NULL").select("doc_id").distinct().withColumn("broken", F.lit(True))
    left = left.join(broken, "doc_id", "left")
    no_local = F.col("b").isNull() & F.col("broken").isNotNull()
    gone = left.select("doc_id", F.col("value").alias("token"), none.alias("local_locator"), "remote_locator", F.when(~no_local, "delete").alias("op"), none.alias("after"), F.when(no_local, "boundary-ambiguous").alias("blocker"))
    return mine.filter("op IS NULL OR op <> 'keep'").drop("pair", "stuck").unionByName(gone)
