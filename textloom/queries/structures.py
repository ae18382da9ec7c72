"""Boundary pairs, nested payloads, synced containers, cell grids and wording, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import canonical as N
from textloom.operators.wording import Wording, rewrite_wording
from textloom.plans.boundaries import boundary_plan as plan_boundaries
from textloom.queries import query
from textloom.queries.markup import _orders, _sql_text
from textloom.runtime import table
from textloom.sources import derived as D

#: Local and remote nodes by variant (tokens in brackets), and what must be planned: token, op, place (the node before), blocker.
BOUNDARIES = {
    0: ("a <S> b </S> c", "a b c", [("<S>", "create", "a", None), ("</S>", "create", "b", None)]),
    1: ("a <S> b </S> c", "a <S> b </S> c", []),
    2: ("a <S> b c </S> d", "a <S> b </S> c d", [("</S>", "move", "c", None)]),
    3: ("a <S> b </S> c", "a <S> b b </S> c", [("<S>", None, None, "pair-blocked"), ("</S>", None, None, "boundary-ambiguous")]),
    4: ("a <S> b", "a b", [("<S>", None, None, "boundary-ambiguous")]),
    5: ("a b", "a <S> b </S>", [("<S>", "delete", None, None), ("</S>", "delete", None, None)]),
    6: ("a b", "a <S> b", [("<S>", None, None, "boundary-ambiguous")]),
    7: ("a <S> x </S> b", "a b", [("<S>", None, None, "pair-blocked"), ("</S>", None, None, "anchor-missing")]),
    8: ("a <S> b <T> c </T> d </S> e", "a <T> b c </T> d e", [("<S>", "create", "a", None), ("<T>", "move", "b", None), ("</S>", "create", "d", None)]),
}


def _node_rows(side: int) -> str:
    rows = []
    for v, case in BOUNDARIES.items():
        seen: dict[str, int] = {}
        for pos, word in enumerate(case[side].split()):
            seen[word] = seen.get(word, 0) + 1
            rows.append(f"({v}, {pos}, '{'authoring-token' if word[0] == '<' else 'text'}', '{word}', '{word}{seen[word]}')")
    return ", ".join(rows)


_PLAN_VALUES = ", ".join(f"({v}, '{token}', {_sql_text(op)}, {_sql_text(after and after + '1')}, {_sql_text(blocker)})" for v, (_, _, plan) in BOUNDARIES.items() for token, op, after, blocker in plan)


@query(f"SELECT c_custkey AS doc_id, token, op, after, blocker FROM customer JOIN (VALUES {_PLAN_VALUES}) v(variant, token, op, after, blocker) ON variant = c_custkey % {len(BOUNDARIES)}")
def boundary_plan(spark, sf):
    nodes = lambda side: spark.sql(f"SELECT c_custkey AS doc_id, CAST(pos AS BIGINT) AS pos, 's' AS section, kind, locator, value FROM {{c}} JOIN (VALUES {_node_rows(side)}) v(variant, pos, kind, value, locator) ON variant = c_custkey % {len(BOUNDARIES)}", c=table(spark, sf, "customer"))
    return plan_boundaries(nodes(0), nodes(1)).select("doc_id", "token", "op", "after", "blocker")


#: Payloads and their leaves in order; § is the order's key.
PAYLOADS = {
    0: ('{"text": {"elements": [{"run": {"content": "§", "bold": true}}], "align": 1}, "block_id": "x", "folded": false}', ['/text/elements#0/run/bold=true', '/text/elements#0/run/content="§"']),
    1: ('{"folded":false,"block_id":"other","text":{"align":1,"elements":[{"run":{"bold":true,"content":"§"},"parent_id":"p"}]}}', ['/text/elements#0/run/bold=true', '/text/elements#0/run/content="§"']),
    2: ('{"table": {"cells": [[1, 2], []], "merge_info": [{"row_span": 2}], "wrap": true, "folded": true}, "a/b~c": {}, "n": null}', ["/a~1b~0c={}", "/n=null", "/table/cells#0#0=1", "/table/cells#0#1=2", "/table/cells#1=[]", "/table/folded=true", "/table/wrap=true"]),
    3: ("not json §", ["!=not json §"]),
    4: ("[[[[[[\"deep §\"]]]]]]", ['#0#0#0#0#0#0="deep §"']),
    5: ('{"block_id": 1, "children": ["§"]}', []),
}
_PAYLOAD_VALUES = ", ".join(f"({v}, {_sql_text(chr(10).join(sorted(leaves)))})" for v, (_, leaves) in PAYLOADS.items())


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS block_id, sha256(replace(leaves, '§', CAST(o_orderkey AS VARCHAR))) AS hash FROM orders JOIN (VALUES {_PAYLOAD_VALUES}) v(variant, leaves) ON variant = o_orderkey % {len(PAYLOADS)}")
def payload_hash(spark, sf):
    return N.payload_hash(_orders(spark, sf, PAYLOADS).select(F.col("doc_id").cast("string").alias("block_id"), F.col("text").alias("payload")))


#: Pages of customers that show one of eight shared sources; sources show each other in chains, one chain ends nowhere, one comes back.
_SYNCED = """SELECT 'page' || c_custkey AS block_id, CAST(NULL AS VARCHAR(9)) AS parent_id, CAST(0 AS BIGINT) AS ordinal, CAST(NULL AS VARCHAR(9)) AS source_id FROM customer
    UNION ALL SELECT 'text' || c_custkey, 'page' || c_custkey, 0, NULL FROM customer UNION ALL SELECT 'ref' || c_custkey, 'page' || c_custkey, 1, 's' || (c_custkey % 8) FROM customer
    UNION ALL SELECT 's' || r, 'shared', r, NULL FROM (SELECT DISTINCT c_custkey % 8 AS r FROM customer) UNION ALL SELECT 'shared', NULL, 0, NULL FROM (SELECT min(c_custkey) FROM customer)
    UNION ALL SELECT 't' || r, 's' || r, 0, NULL FROM (SELECT DISTINCT c_custkey % 8 AS r FROM customer)
    UNION ALL SELECT 'in' || r, 't' || r, 0, CASE r WHEN 3 THEN 'gone' WHEN 5 THEN 's4' WHEN 7 THEN 's7' ELSE 's' || (r + 1) END FROM (SELECT DISTINCT c_custkey % 8 AS r FROM customer)"""


@query(f"""WITH RECURSIVE b AS ({_SYNCED}), e AS (
    SELECT block_id AS path, block_id, CAST(NULL AS VARCHAR) AS parent_path, ordinal, source_id, [block_id] AS seen, CAST(NULL AS VARCHAR) AS issue FROM b WHERE parent_id IS NULL
    UNION ALL SELECT e.path || '/' || k.block_id, k.block_id, e.path, k.ordinal, k.source_id, list_concat(e.seen, [e.source_id, k.block_id]),
        CASE WHEN k.source_id NOT IN (SELECT block_id FROM b) THEN 'missing-source' WHEN list_contains(list_concat(e.seen, [e.source_id, k.block_id]), k.source_id) THEN 'cycle' END
    FROM e JOIN b k ON k.parent_id = coalesce(e.source_id, e.block_id) WHERE e.issue IS NULL)
    SELECT path, block_id, parent_path, ordinal, issue FROM e""")
def expand_synced(spark, sf):
    return N.expand_synced(spark.sql(_SYNCED.replace("FROM customer", "FROM {c}"), c=table(spark, sf, "customer")))


_GRID_TABLES = "SELECT table_key AS table_id, CAST(ceil(count(*) / 2.0) AS INT) AS rows, 2 AS columns FROM tbl_base GROUP BY table_key"
_GRID_CELLS = "SELECT table_key AS table_id, row_key - 1 AS ordinal, 'c' || table_key || '.' || row_key AS cell_id, CASE WHEN table_key % 5 = 1 AND row_key = 1 THEN 2 ELSE 1 END AS row_span, CASE WHEN table_key % 7 = 2 AND row_key IN (1, 4) THEN 2 ELSE 1 END AS col_span FROM tbl_base WHERE NOT (table_key % 9 = 4 AND row_key = 2)"


@query(f"""{D.with_ctes('tbl_base')}, t AS ({_GRID_TABLES}), c AS (SELECT *, ordinal // 2 AS row, ordinal % 2 AS col FROM ({_GRID_CELLS})),
    p AS (SELECT table_id, row, col, rows FROM (SELECT table_id, rows, unnest(range(rows)) AS row FROM t), (VALUES (0), (1)) v(col))
    SELECT p.table_id, p.row, p.col, own.cell_id, min(over.cell_id) AS covered_by, CASE WHEN own.cell_id IS NULL THEN 'missing-cell' WHEN count(over.cell_id) > 1 THEN 'overlap' WHEN p.row + own.row_span > rows OR p.col + own.col_span > 2 THEN 'outside' END AS issue
    FROM p LEFT JOIN c own ON own.table_id = p.table_id AND own.row = p.row AND own.col = p.col
    LEFT JOIN c over ON over.table_id = p.table_id AND (over.row, over.col) <> (p.row, p.col) AND p.row >= over.row AND p.row < over.row + over.row_span AND p.col >= over.col AND p.col < over.col + over.col_span
    GROUP BY p.table_id, p.row, p.col, rows, own.cell_id, own.row_span, own.col_span""")
def cell_grid(spark, sf):
    base = D.tables(spark, sf)[0]
    tables, cells = (spark.sql(q.replace("tbl_base", "{b}"), b=base) for q in (_GRID_TABLES, _GRID_CELLS))
    return N.cell_grid(tables, cells)


WORDINGS = [Wording(mention=r"\bAcme\b", versioned=r"\bAcme\s+v?\d+(?:\.\d+)*", target="acme", name="Acme", other_target="zen", other_name="Zen Cloud")]
_DUAL = '<include target="acme">Acme</include><include target="zen">Zen Cloud</include>'
WORDED = {
    0: ("Use Acme here. Since Acme 2.4 it is fast!  See `Acme` and [Acme](x).", f'Use {_DUAL} here. <include target="acme">Since Acme 2.4 it is fast!</include>  See `Acme` and [Acme](x).', ""),
    1: ("# Acme §\n```\nAcme\n```\nAcme is Acme", f"# Acme §\n```\nAcme\n```\n{_DUAL} is {_DUAL}", "# Acme §"),
    2: ('<include target="x">Acme</include> and Acmes. In v3. Acme v3 has [a. b](Acme) inside. Done', '<include target="x">Acme</include> and Acmes. In v3. <include target="acme">Acme v3 has [a. b](Acme) inside.</include> Done', ""),
    3: ("plain §\r\n\r\nAcme?Acme", f"plain §\n\n{_DUAL}?{_DUAL}", ""),
}
_WORDED_VALUES = ", ".join(f"({v}, {_sql_text(want)}, {_sql_text(warned)})" for v, (_, want, warned) in WORDED.items())


@query(f"SELECT o_orderkey AS doc_id, replace(text, '§', CAST(o_orderkey AS VARCHAR)) AS text, replace(warned, '§', CAST(o_orderkey AS VARCHAR)) AS warnings FROM orders JOIN (VALUES {_WORDED_VALUES}) v(variant, text, warned) ON variant = o_orderkey % {len(WORDED)}")
def rewrite_sentences(spark, sf):
    return rewrite_wording(_orders(spark, sf, WORDED), WORDINGS).withColumn("warnings", F.array_join("warnings", "|"))
