"""Folds of block trees from the leaves up: rolled-up hashes and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators.fold import rolled_up_hash
from textloom.operators.ranges import numbered
from textloom.operators.render import render_tree
from textloom.queries import query
from textloom.runtime import table
from textloom.sources import derived as D

#: The tree's levels by the first letter of their ids, leaves first; a level's children are hashed in order, in stretches that each parent here has one of.
_LEVELS = ("o", "c", "n", "r")
_ROLLED = ", ".join(
    f"""f_{name} AS (SELECT block_id, parent_id, pos, sha256(sha256(block_id || '|' || payload) || '|' || {"'leaf'" if i == 0 else "coalesce(kids, 'leaf')"}) AS h FROM t {'' if i == 0 else f"LEFT JOIN (SELECT parent_id AS up, sha256(sha256(string_agg(h, ',' ORDER BY pos, block_id))) AS kids FROM f_{(*_LEVELS, 'root')[i - 1]} GROUP BY 1) k ON k.up = t.block_id"} WHERE substr(block_id, 1, 1) = '{name[0]}' AND (block_id = 'root') = {name == 'root'})"""
    for i, name in enumerate((*_LEVELS, "root"))
)


@query(f"{D.with_ctes('tree')}, t AS (SELECT * FROM tree), {_ROLLED} " + " UNION ALL ".join(f"SELECT block_id, {depth} AS depth, h AS hash FROM f_{name}" for depth, name in ((4, "o"), (3, "c"), (2, "n"), (1, "r"), (0, "root"))))
def rolled_up_hashes(spark, sf):
    blocks = numbered(D.tree(spark, sf).withColumn("doc_id", F.lit(1)), ["doc_id", "parent_id"], ["pos", "block_id"])
    return rolled_up_hash(blocks, F.sha2(F.concat_ws("|", "block_id", "payload"), 256)).select("block_id", "depth", "hash")


#: Pages of customers: a heading, their orders as a list with lines below, a table of orders, a callout, code and an unknown block.
#: A line's order is never null after the join; coalesce says so, and a search for roots needn't read the lines.
_PAGES = """
    SELECT c_custkey AS doc_id, 'page' AS block_id, CAST(NULL AS STRING) AS parent_id, CAST(0 AS BIGINT) AS pos, 1 AS block_type, '' AS text, 0 AS columns FROM {c}
    UNION ALL SELECT c_custkey, 'head', 'page', 1, 4, c_name, 0 FROM {c}
    UNION ALL SELECT o_custkey, 'o' || o_orderkey, 'page', 10 + o_orderkey, 12, 'order ' || o_orderkey, 0 FROM {o}
    UNION ALL SELECT o_custkey, 'l' || table_key || '.' || row_key, 'o' || coalesce(o_orderkey, 0), row_key, 13, 'line ' || row_key || c3, 0 FROM {l} JOIN {o} ON table_key = o_orderkey
    UNION ALL SELECT c_custkey, 'table', 'page', 1000000001, 31, '', 2 FROM {c}
    UNION ALL SELECT o_custkey, 'cell' || n || '.' || o_orderkey, 'table', o_orderkey * 2 + n, 2, CASE n WHEN 0 THEN o_orderpriority ELSE o_orderstatus END, 0 FROM {o} CROSS JOIN (VALUES (0), (1)) v(n)
    UNION ALL SELECT c_custkey, 'call', 'page', 1000000002, 19, '', 0 FROM {c}
    UNION ALL SELECT c_custkey, 'call.' || n, 'call', n, 2, CASE n WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN '**Warning:**' ELSE c_mktsegment END ELSE 'said' END, 0 FROM {c} CROSS JOIN (VALUES (0), (1)) v(n)
    UNION ALL SELECT c_custkey, 'code', 'page', 1000000003, 14, 'run ' || c_custkey, 0 FROM {c}
    UNION ALL SELECT c_custkey, 'odd', 'page', 1000000004, 99, '', 0 FROM {c} WHERE c_custkey % 5 = 0"""

_NL, _GAP = "chr(10)", "chr(10) || chr(10)"


@query(f"""{D.with_ctes('tbl_base')}, l AS (SELECT table_key, string_agg('    1. line ' || row_key || c3, {_GAP} ORDER BY row_key) AS t FROM tbl_base GROUP BY 1),
    o AS (SELECT o_custkey, string_agg('- order ' || o_orderkey || coalesce({_GAP} || l.t, ''), {_GAP} ORDER BY o_orderkey) AS t FROM orders LEFT JOIN l ON table_key = o_orderkey GROUP BY 1),
    r AS (SELECT o_custkey, list('| ' || o_orderpriority || ' | ' || o_orderstatus || ' |' ORDER BY o_orderkey) AS a FROM orders GROUP BY 1)
    SELECT c_custkey AS doc_id, sha256('## ' || c_name || coalesce({_GAP} || o.t, '') || coalesce({_GAP} || a[1] || {_NL} || '| --- | --- |' || CASE WHEN len(a) > 1 THEN {_NL} || array_to_string(a[2:], {_NL}) ELSE '' END, '') || {_GAP}
        || CASE WHEN c_custkey % 3 = 0 THEN '<div class="alert warning">' || {_GAP} || 'said' ELSE '<div class="alert note">' || {_GAP} || c_mktsegment || {_GAP} || 'said' END || {_GAP} || '</div>'
        || {_GAP} || '```sh' || {_NL} || 'run ' || c_custkey || {_NL} || '```' || CASE WHEN c_custkey % 5 = 0 THEN {_GAP} || '<!-- block type 99 omitted -->' ELSE '' END || {_NL}) AS text_hash
    FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN r ON r.o_custkey = c_custkey""")
def render_pages(spark, sf):
    blocks = spark.sql(_PAGES, c=table(spark, sf, "customer"), o=table(spark, sf, "orders"), l=D.base_table(spark, sf)).withColumn("language", F.when(F.col("block_type") == 14, "sh"))
    return render_tree(blocks).select("doc_id", F.sha2("text", 256).alias("text_hash"))
