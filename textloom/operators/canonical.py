"""Canonical forms of nested payloads by their leaves, and block references resolved to trees and grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import materialize

#: Keys that say nothing of the content, and values that are defaults (as JSON).
VOLATILE = ("block_id", "parent_id", "children", "merge_info")
DEFAULTS = (("folded", "false"), ("align", "1"), ("wrap", "false"))


def payload_leaves(payloads: DataFrame, volatile: tuple[str, ...] = VOLATILE, defaults: tuple[tuple[str, str], ...] = DEFAULTS) -> DataFrame:
    """(block_id, path, leaf) of JSON texts (block_id, payload): every scalar and empty container, level by level.

    Volatile keys go at any depth with all below them, keys with default values too. Object keys are ``/key``, array places ``#place``.
    Text that is no JSON is one leaf; null has none.
    """
    parsed = payloads.filter("payload IS NOT NULL").select("block_id", F.lit("").alias("path"), F.try_parse_json("payload").alias("v"), "payload")
    out = [parsed.filter("v IS NULL").select("block_id", F.lit("!").alias("path"), F.col("payload").alias("leaf"))]
    level = materialize(parsed.filter("v IS NOT NULL").select("block_id", "path", F.to_json("v").alias("j")), "payload-level")
    while not level.isEmpty():
        inner = F.substring("j", 1, 1).isin("{", "[") & (F.length("j") > 2)
        out.append(level.filter(~inner).select("block_id", "path", F.col("j").alias("leaf")))
        drop_keys, drop_values = ", ".join(f"'{k}'" for k in volatile) or "''", " OR ".join(f"(key = '{k}' AND j = '{v}')" for k, v in defaults) or "false"
        below = payloads.sparkSession.sql(
            f"""
            SELECT block_id, path || coalesce('/' || replace(replace(key, '~', '~0'), '/', '~1'), '#' || pos) AS path, j
            FROM (SELECT l.block_id, l.path, e.key, e.pos, to_json(e.value) AS j FROM {{l}} AS l, LATERAL variant_explode(parse_json(l.j)) e)
            WHERE coalesce(key, '') NOT IN ({drop_keys}) AND NOT coalesce({drop_values}, false)""",
            l=level.filter(inner),
        )
        level = materialize(below, "payload-level")
    return reduce(DataFrame.unionByName, out)


def payload_hash(payloads: DataFrame, volatile: tuple[str, ...] = VOLATILE, defaults: tuple[tuple[str, str], ...] = DEFAULTS) -> DataFrame:
    """(block_id, hash): the order of keys and what is volatile or default change nothing, any other leaf does."""
    leaves = payload_leaves(payloads, volatile, defaults).groupBy("block_id").agg(F.array_sort(F.collect_list(F.concat("path", F.lit("="), "leaf"))).alias("l"))
    j = payloads.select("block_id").distinct().join(leaves, "block_id", "left")
    return j.select("block_id", F.sha2(F.coalesce(F.array_join("l", "\n"), F.lit("")), 256).alias("hash"))


def expand_synced(blocks: DataFrame) -> DataFrame:
    """(path, block_id, parent_path, ordinal, issue): trees with what synced references show in their place.

    ``blocks`` are (block_id, parent_id, ordinal, source_id): a block with a source shows that block's children as its own, and so on inside. A path is the
    blocks' ids from the root on. Issues: ``cycle`` (a reference inside what it shows), ``missing-source``; neither goes on below.
    """
    level = blocks.filter("parent_id IS NULL").select(F.col("block_id").alias("path"), "block_id", F.lit(None).cast("string").alias("parent_path"), "ordinal", "source_id", F.array("block_id").alias("seen"))
    ids = blocks.select(F.col("block_id").alias("source_id"), F.lit(True).alias("there")).distinct()
    kids = blocks.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("holder"), F.col("block_id").alias("child"), F.col("ordinal").alias("at"), F.col("source_id").alias("of"))
    out, level = [], materialize(level, "synced-level")
    while not level.isEmpty():
        # ``seen`` holds the blocks whose children stand above: coming to one again never ends
        checked = level.join(ids, "source_id", "left")
        issue = F.when(F.col("source_id").isNotNull() & F.col("there").isNull(), "missing-source").when(F.array_contains("seen", F.col("source_id")), "cycle")
        checked = materialize(checked.select("path", "block_id", "parent_path", "ordinal", "source_id", "seen", issue.alias("issue")), "synced-level")
        out.append(checked.select("path", "block_id", "parent_path", "ordinal", "issue"))
        holders = checked.filter("issue IS NULL").select("path", F.coalesce("source_id", "block_id").alias("holder"), F.array_union("seen", F.array_compact(F.array("source_id"))).alias("seen"))
        below = holders.join(kids, "holder")
        level = materialize(below.select(F.concat_ws("/", "path", "child").alias("path"), F.col("child").alias("block_id"), F.col("path").alias("parent_path"), F.col("at").alias("ordinal"), F.col("of").alias("source_id"), F.array_union("seen", F.array("child")).alias("seen")), "synced-level")
    return reduce(DataFrame.unionByName, out) if out else level.select("path", "block_id", "parent_path", "ordinal", F.lit(None).cast("string").alias("issue"))


def cell_grid(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_id, row, col, cell_id, covered_by, issue): every place of each table's grid.

    ``tables`` are (table_id, rows, columns), ``cells`` (table_id, ordinal, cell_id, row_span, col_span), row by row. A place under another cell's span names it in
    ``covered_by``. Issues: ``missing-cell`` (a place without a cell), ``overlap`` (under two spans), ``outside`` (a cell or span beyond the grid).
    """
    size = tables.select("table_id", "rows", "columns")
    own = cells.join(size, "table_id").select("table_id", "cell_id", "rows", "columns", F.floor(F.col("ordinal") / F.col("columns")).cast("int").alias("row"), (F.col("ordinal") % F.col("columns")).cast("int").alias("col"), F.greatest(F.coalesce("row_span", F.lit(1)), F.lit(1)).alias("h"), F.greatest(F.coalesce("col_span", F.lit(1)), F.lit(1)).alias("w"))
    own = materialize(own, "cells")
    places = size.filter("rows > 0 AND columns > 0").select("table_id", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "columns").select("table_id", "row", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("col"))
    spans = own.filter("h > 1 OR w > 1").select("table_id", "cell_id", F.col("row").alias("r0"), F.col("col").alias("c0"), F.explode(F.sequence(F.col("row"), F.least(F.col("row") + F.col("h"), F.col("rows")) - 1)).alias("row"), "w", "columns")
    spans = spans.select("table_id", "cell_id", "r0", "c0", "row", F.explode(F.sequence(F.col("c0"), F.least(F.col("c0") + F.col("w"), F.col("columns")) - 1)).alias("col")).filter("row <> r0 OR col <> c0")
    covers = spans.groupBy("table_id", "row", "col").agg(F.min("cell_id").alias("covered_by"), F.count(F.lit(1)).alias("covers"))
    at = ["table_id", "row", "col"]
    j = places.join(own.select(*at, "cell_id", ((F.col("row") + F.col("h") > F.col("rows")) | (F.col("col") + F.col("w") > F.col("columns"))).alias("out")), at, "left").join(covers, at, "left")
    issue = F.when(F.col("cell_id").isNull(), "missing-cell").when(F.col("covers") > 1, "overlap").when(F.col("out"), "outside")
    beyond = own.filter("row >= rows").select(*at, "cell_id", F.lit(None).cast("string").alias("covered_by"), F.lit("outside").alias("issue"))
    return j.select(*at, "cell_id", "covered_by", issue.alias("issue")).unionByName(beyond)
