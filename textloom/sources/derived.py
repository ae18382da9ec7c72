"""Inputs that queries derive from the given tables, in Spark and as SQL for the oracle.

``rich`` gives every document Markdown structure: each of its lines becomes, by its number and the
document's id, a heading, list item, fence, link, image, table, callout, span and so on, built from the
line's own words. Both engines run one and the same expression per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.runtime import materialize, table

_WORD = "coalesce(nullif(translate(split_part(l, ' ', {n}), '.,|!#$%&*<>[]()\"=+@''`', ''), ''), 'w{n}')"


def _line_case(no: str) -> str:
    """SQL for the Markdown of line ``l`` with 0-based number ``no`` of document ``doc_id``."""
    w1, w2 = _WORD.format(n=1), _WORD.format(n=2)
    nl = "chr(10)"
    a1, a2 = (f"'{c}' || cast(length(l) % {m} AS VARCHAR(9)) || '-' || cast(doc_id % 7 AS VARCHAR(9))" for c, m in (("p", 40), ("q", 30)))
    cases = {
        1: "'## ' || l",
        2: "'- ' || l",
        3: "'3. ' || l",
        4: f"'```python' || {nl} || l || {nl} || '```'",
        5: f"'See [' || {w1} || '](./' || {a2} || '.md#part) and [' || {w2} || '](https://docs.example.com/wiki/' || {a1} || ') here.'",
        6: f"'![' || {w1} || '](./images/' || {a1} || '.png)'",
        7: f"'| key | value |' || {nl} || '| --- | :---: |' || {nl} || '| ' || {w1} || ' | ' || {w2} || ' |' || {nl} || '| ' || {w2} || '2 | x |'",
        8: f"':::note' || {nl} || l || {nl} || ':::'",
        9: f"'<include target=\"alpha\">' || {w1} || '</include> ' || l || ' <exclude target=\"alpha\">' || {w2} || '</exclude>'",
        10: f"'<div class=\"alert note\">' || {nl} || l || {nl} || '</div>'",
        11: f"'### ' || {w1} || ' {{#' || {a1} || '}}'",
        12: f"'<table><tr><th>k</th><th>v</th></tr><tr><td>' || {w1} || '</td><td>' || {w2} || '</td></tr></table>'",
        13: "'import Part from \"./part\"'",
        14: "'<Steps>'",
        15: "'</Steps>'",
        16: f"'Use {{{{var.' || {a1} || '}}}} now.  '",
        17: "'    ' || l",
        18: f"'<include target=\"beta\">' || {w2} || '</include>'",
    }
    head = f"'---' || {nl} || 'title: ' || {w1} || {nl} || 'slug: doc-' || cast(doc_id AS VARCHAR(20)) || {nl} || '---' || {nl} || '# ' || l"
    whens = " ".join(f"WHEN (doc_id + {no}) % 23 = {k} THEN {v}" for k, v in cases.items())
    return f"CASE WHEN {no} = 0 THEN {head} {whens} ELSE l END"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: every document with Markdown structure."""
    # Spark's lambdas and DuckDB's spell differently; the body is shared
    return docs(spark, sf_dir).select("doc_id", F.expr(f"array_join(transform(split(text, '\\n'), (l, i) -> {_line_case('i')}), '\\n')").alias("text"))


#: CTEs for the oracle, by name.
CTES = {
    "rich": f"rich AS (SELECT doc_id, string_agg({_line_case('i')}, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS l FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)) GROUP BY doc_id)",
    "lines": "lines AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM rich))",
}


def four_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, l0, l1, r0, r1: base and current text of two sides, changed in some documents."""
    spoil = lambda mod, rest, line, word: f"array_join(transform(split(text, '\\n'), (l, i) -> CASE WHEN doc_id % {mod} = {rest} AND i % 6 = {line} THEN l || ' {word}' ELSE l END), '\\n')"
    r = rich(spark, sf_dir)
    return r.select("doc_id", F.col("text").alias("l0"), F.expr(spoil(4, 1, 1, "local")).alias("l1"), F.col("text").alias("r0"), F.expr(spoil(3, 1, 4, "remote")).alias("r1"))


CTES["four"] = (
    "four AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS l0, string_agg(CASE WHEN doc_id % 4 = 1 AND line_no % 6 = 1 THEN line || ' local' ELSE line END, chr(10) ORDER BY line_no) AS l1, "
    "string_agg(line, chr(10) ORDER BY line_no) AS r0, string_agg(CASE WHEN doc_id % 3 = 1 AND line_no % 6 = 4 THEN line || ' remote' ELSE line END, chr(10) ORDER BY line_no) AS r1 FROM lines GROUP BY doc_id)"
)


def receipts(four: DataFrame) -> DataFrame:
    """doc_id, version, draft_hash, remote_hash, dialect of documents synchronised before."""
    return four.filter("doc_id % 5 <> 0").select("doc_id", (F.col("doc_id") % 5 + 1).cast("int").alias("version"), F.sha2("l0", 256).alias("draft_hash"), F.sha2("r0", 256).alias("remote_hash"), F.when(F.col("doc_id") % 11 == 3, "other").otherwise("plain").alias("dialect"))


CTES["receipts"] = "receipts AS (SELECT doc_id, CAST(doc_id % 5 + 1 AS INTEGER) AS version, sha256(l0) AS draft_hash, sha256(r0) AS remote_hash, CASE WHEN doc_id % 11 = 3 THEN 'other' ELSE 'plain' END AS dialect FROM four WHERE doc_id % 5 <> 0)"

_BASE = "SELECT l_orderkey AS table_key, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS row_key, CAST(l_quantity AS DOUBLE) AS c1, CAST(l_extendedprice AS DOUBLE) AS c2, CAST(l_returnflag AS VARCHAR(20)) AS c3 FROM lineitem"
_CHANGED = (
    "SELECT table_key, row_key, CASE WHEN table_key % {m1} = 1 AND row_key = 1 THEN c1 + 1 ELSE c1 END AS c1, c2, CASE WHEN table_key % {m2} = 2 AND row_key = 2 THEN 'X' ELSE c3 END AS c3 FROM tbl_base WHERE NOT (table_key % 10 = {gone} AND row_key = 1) "
    "UNION ALL SELECT DISTINCT table_key, 1000, CAST(0 AS DOUBLE), CAST({new} AS DOUBLE), 'new' FROM tbl_base WHERE table_key % 10 = {added} "
    "UNION ALL SELECT table_key, 0, c1, CASE WHEN table_key % 3 = 0 THEN c2 + {new} ELSE c2 END, c3 FROM tbl_base WHERE table_key % 20 = {gone} AND row_key = 1"
)
# a row that is gone from a table goes on as row 0 in some of them: a rename
_CUR, _REMOTE = _CHANGED.format(m1=4, m2=6, gone=7, added=3, new=1), _CHANGED.format(m1=5, m2=7, gone=9, added=13, new=2)
CTES |= {"tbl_base": f"tbl_base AS ({_BASE})", "tbl_cur": f"tbl_cur AS ({_CUR})", "tbl_remote": f"tbl_remote AS ({_REMOTE})"}


def base_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base alone, not written, for a job that reads it once."""
    return spark.sql(_BASE.replace("FROM lineitem", "FROM {li}"), li=table(spark, sf_dir, "lineitem"))


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyed rows (table_key, row_key, c1, c2, c3): a base and two changed copies, from lineitem.

    The base is written once: a copy reads it three times, and each time the rows would be shuffled and numbered anew.
    """
    base = materialize(base_table(spark, sf_dir), "base-rows")
    return base, *(spark.sql(q.replace("tbl_base", "{b}"), b=base) for q in (_CUR, _REMOTE))


CTES["page_links"] = "page_links AS (SELECT page_id, CAST(unnest(range(len(u))) AS INTEGER) AS occ, unnest(u) AS url FROM (SELECT page_id, regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1) AS u FROM pages))"
CTES["link_index"] = (
    "slugs AS (SELECT DISTINCT regexp_replace(url, '^/+', '') AS slug FROM page_links), link_index AS (SELECT slug, 'https://docs.example.com/wiki/' || regexp_replace(slug, '[^A-Za-z0-9]+', '', 'g') AS url, 'page' AS placement FROM slugs WHERE length(slug) % 10 <> 4 "
    "UNION ALL SELECT slug, 'https://docs.example.com/docx/' || regexp_replace(slug, '[^A-Za-z0-9]+', '', 'g'), 'page' FROM slugs WHERE length(slug) % 10 = 7)"
)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, occ, url: every site-relative link of the pages, in order."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("occ", "url"))


def link_index(links: DataFrame) -> DataFrame:
    """slug, url, placement: most slugs of the links once, some twice with different URLs, some not at all."""
    slugs = links.select(F.regexp_replace("url", "^/+", "").alias("slug")).distinct()
    code = F.regexp_replace("slug", "[^A-Za-z0-9]+", "")
    one = slugs.filter("length(slug) % 10 <> 4").select("slug", F.concat(F.lit("https://docs.example.com/wiki/"), code).alias("url"), F.lit("page").alias("placement"))
    two = slugs.filter("length(slug) % 10 = 7").select("slug", F.concat(F.lit("https://docs.example.com/docx/"), code).alias("url"), F.lit("page").alias("placement"))
    return one.unionByName(two)


_TREE = (
    "SELECT 'r' || CAST(r_regionkey AS VARCHAR(20)) AS block_id, 'root' AS parent_id, CAST(r_name AS VARCHAR(40)) AS payload, r_regionkey AS pos FROM region UNION ALL SELECT 'root', CAST(NULL AS VARCHAR(9)), 'root', 0 "
    "UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR(20)), 'r' || CAST(n_regionkey AS VARCHAR(20)), CAST(n_name AS VARCHAR(40)), n_nationkey FROM nation "
    "UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR(20)), 'n' || CAST(c_nationkey AS VARCHAR(20)), CAST(c_mktsegment AS VARCHAR(40)), c_custkey FROM customer "
    "UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR(20)), 'c' || CAST(o_custkey AS VARCHAR(20)), CAST(o_orderpriority AS VARCHAR(40)), o_orderkey FROM orders"
)
CTES["tree"] = f"tree AS ({_TREE})"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_id, parent_id, payload, pos: region, nation, customer and order as one tree of blocks."""
    sql = _TREE
    frames = {t: table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders")}
    for t in frames:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **frames)


_NODES = (
    "SELECT conv_id AS doc_id, turn * 10 AS pos, role AS section, CASE WHEN turn % 3 = 0 THEN 'code' ELSE 'text' END AS kind, conv_id * 7 + turn AS k, "
    "role || ':' || CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS VARCHAR(9)) AS locator, CASE WHEN conv_id % 8 = 2 AND turn IN (1, 4, 5) THEN 'Said again.' ELSE coalesce(text, '') END AS value FROM conversations"
)
#: A side edits, drops, adds and moves nodes; its locators are counted anew, so that they shift.
_SIDE = (
    "SELECT doc_id, pos, section, kind, section || ':' || CAST(row_number() OVER (PARTITION BY doc_id, section ORDER BY pos) AS VARCHAR(9)) AS locator, value FROM ("
    "SELECT doc_id, pos + CASE WHEN k % 23 = 7 THEN 23 ELSE 0 END AS pos, section, kind, CASE WHEN k % {u} = 1 THEN value || ' {s}' ELSE value END AS value FROM n0 WHERE k % {d} <> 3 "
    "UNION ALL SELECT doc_id, pos + 5, section, kind, 'added ' || CAST(k % 4 AS VARCHAR(9)) FROM n0 WHERE k % {a} = 4)"
)
_L1, _R1 = _SIDE.format(u=5, d=11, a=13, s="L"), _SIDE.format(u=6, d=17, a=19, s="R")
CTES |= {"n0": f"n0 AS ({_NODES})", "n_l1": f"n_l1 AS ({_L1})", "n_r1": f"n_r1 AS ({_R1})"}


def identified_cte(side: str, base: str = "n0") -> str:
    """CTEs up to ``i_<side>``: a side's nodes with the locator of the base node that each is."""
    s = side
    left = lambda t, own: f"(SELECT *, row_number() OVER (PARTITION BY doc_id, after, before ORDER BY pos) AS nth, count(*) OVER (PARTITION BY doc_id, after, before) AS n FROM (SELECT t.*, p.node AS known, coalesce(last_value(p.node IGNORE NULLS) OVER (PARTITION BY t.doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS after, coalesce(first_value(p.node IGNORE NULLS) OVER (PARTITION BY t.doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS before FROM {t} t LEFT JOIN {s}_p p ON p.doc_id = t.doc_id AND p.{own} = t.locator) WHERE known IS NULL)"
    once = lambda t, keys: f"(SELECT {keys} FROM {t} GROUP BY {keys} HAVING count(*) = 1)"
    pair = lambda a, b, keys: f"SELECT x.doc_id, x.locator AS node, y.locator AS loc FROM {a} x JOIN {b} y USING ({keys}) JOIN {once(a, keys)} USING ({keys}) JOIN {once(b, keys)} USING ({keys})"
    return ", ".join((
        f"{s}_p1 AS ({pair(base, s, 'doc_id, section, value')})",
        f"{s}_a AS (SELECT b.* FROM {base} b ANTI JOIN {s}_p1 p ON p.doc_id = b.doc_id AND p.node = b.locator)", f"{s}_b AS (SELECT b.* FROM {s} b ANTI JOIN {s}_p1 p ON p.doc_id = b.doc_id AND p.loc = b.locator)",
        f"{s}_p AS (SELECT * FROM {s}_p1 UNION ALL {pair(s + '_a', s + '_b', 'doc_id, value')})",
        f"{s}_q AS (SELECT * FROM {s}_p UNION ALL SELECT x.doc_id, x.locator, y.locator FROM {left(base, 'node')} x JOIN {left(s, 'loc')} y USING (doc_id, after, before, nth, n, kind))",
        f"i_{s} AS (SELECT t.* REPLACE (coalesce(q.node, 'new|' || t.locator) AS locator) FROM {s} t LEFT JOIN {s}_q q ON q.doc_id = t.doc_id AND q.loc = t.locator)",
    ))


CTES |= {"i_n_l1": identified_cte("n_l1"), "i_n_r1": identified_cte("n_r1")}


def nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, local, remote) nodes of conversations as documents: doc_id, pos, section, kind, locator, value."""
    base = spark.sql(_NODES.replace("FROM conversations", "FROM {c}"), c=table(spark, sf_dir, "conversations"))
    sides = (spark.sql(q.replace("FROM n0", "FROM {b}"), b=base) for q in (_L1, _R1))
    return base.drop("k"), *sides


_NEEDS = {"lines": ["rich"], "four": ["rich", "lines"], "receipts": ["rich", "lines", "four"], "tbl_cur": ["tbl_base"], "tbl_remote": ["tbl_base"], "link_index": ["page_links"], "n_l1": ["n0"], "n_r1": ["n0"], "i_n_l1": ["n0", "n_l1"], "i_n_r1": ["n0", "n_r1"]}


def with_ctes(*names: str) -> str:
    """WITH clause for the named inputs and what they build on; more CTEs may follow after a comma."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    return "WITH RECURSIVE " + ", ".join(CTES[n] for n in order)
