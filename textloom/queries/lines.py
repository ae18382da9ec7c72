"""Lines, code ranges, blocks, sections and locators."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import lines as L
from textloom.queries import query
from textloom.sources import derived as D

_LINES = D.with_ctes("lines")
#: Fences of the derived texts open with ```python, hold one line and close.
_FENCED = f"{_LINES}, fences AS (SELECT doc_id, line_no AS first, line_no + 2 AS last FROM lines WHERE line = '```python')"
_KINDS = _FENCED + """, kinds AS (
    SELECT l.doc_id, line_no, line, f.first AS fence,
        CASE WHEN f.first IS NOT NULL THEN 'code' WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,6}\\s+.+$') THEN 'heading' WHEN regexp_matches(line, '^\\s*[-*]\\s+.+$') THEN 'bullet'
             WHEN regexp_matches(line, '^\\s*\\d+[.)]\\s+.+$') THEN 'ordered' WHEN regexp_matches(line, '^\\s*\\|.*\\|\\s*$') THEN 'table' ELSE 'paragraph' END AS kind
    FROM lines l LEFT JOIN fences f ON l.doc_id = f.doc_id AND line_no BETWEEN f.first AND f.last),
    starts AS (SELECT *, CASE WHEN kind = 'paragraph' THEN lag(kind) OVER w IS DISTINCT FROM 'paragraph' AND lag(kind) OVER w IS DISTINCT FROM 'bullet' AND lag(kind) OVER w IS DISTINCT FROM 'ordered'
        WHEN kind = 'table' THEN lag(kind) OVER w IS DISTINCT FROM 'table' WHEN kind = 'code' THEN fence = line_no ELSE kind <> 'blank' END AS starts FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    numbered AS (SELECT *, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS block_no FROM starts),
    raw AS (SELECT doc_id, block_no, min_by(kind, line_no) AS kind, min(line_no) AS first, string_agg(line, chr(10) ORDER BY line_no) AS lf, string_agg(trim(line), ' ' ORDER BY line_no) AS sp FROM numbered WHERE kind <> 'blank' GROUP BY doc_id, block_no),
    blocks AS (SELECT doc_id, block_no, kind, CASE WHEN kind = 'heading' THEN length(regexp_extract(sp, '^#+', 0)) END AS level, first,
        CASE kind WHEN 'code' THEN lf WHEN 'table' THEN lf WHEN 'heading' THEN regexp_replace(sp, '^#{1,6}\\s+', '') WHEN 'bullet' THEN regexp_replace(sp, '^[-*]\\s+', '') WHEN 'ordered' THEN regexp_replace(sp, '^\\d+[.)]\\s+', '') ELSE sp END AS text FROM raw)"""


@query(f"""{_LINES}, n AS (SELECT *, length(line) + CASE WHEN line_no < max(line_no) OVER (PARTITION BY doc_id) THEN 1 ELSE 0 END AS n FROM lines)
    SELECT doc_id, line_no, line, sum(n) OVER w - n AS start, sum(n) OVER w AS stop FROM n WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""")
def explode_lines(spark, sf):
    return L.line_offsets(D.rich(spark, sf))


@query(f"{_FENCED} SELECT doc_id, first, last, true AS closed FROM fences")
def fence_state(spark, sf):
    return L.fence_ranges(D.rich(spark, sf))


def _protected(spark, sf):
    rich = D.rich(spark, sf)
    return L.with_protected(L.explode_lines(rich), L.fence_ranges(rich))


@query(_KINDS + """, free AS (SELECT *, regexp_matches(line, '^( {4}|\\t)') AS deep FROM kinds WHERE kind <> 'code' AND (trim(line) <> '' OR regexp_matches(line, '^( {4}|\\t)'))),
    islands AS (SELECT *, line_no - 0 AS no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - row_number() OVER (PARTITION BY doc_id, deep ORDER BY line_no) AS g FROM free)
    SELECT doc_id, min(line_no) AS first, max(line_no) AS last FROM islands WHERE deep GROUP BY doc_id, g""")
def indented_ranges(spark, sf):
    return L.indented_ranges(_protected(spark, sf))


@query(_KINDS + " SELECT doc_id, line_no, kind = 'code' AS protected FROM kinds")
def protected_lines(spark, sf):
    return _protected(spark, sf).select("doc_id", "line_no", "protected")


@query(_KINDS + " SELECT * FROM blocks")
def extract_blocks(spark, sf):
    return L.extract_blocks(D.rich(spark, sf))


@query(_KINDS + """, h AS (SELECT *, lower(trim(text)) AS t, max(CASE WHEN level = 1 THEN block_no END) OVER w AS b1, max(CASE WHEN level <= 1 THEN block_no END) OVER w AS u1, max(CASE WHEN level = 2 THEN block_no END) OVER w AS b2, max(CASE WHEN level = 3 THEN block_no END) OVER w AS b3
        FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_no))
    SELECT h.doc_id, h.block_no, concat_ws(' / ', p1.t, p2.t, p3.t) AS section FROM h LEFT JOIN h p1 ON p1.doc_id = h.doc_id AND p1.block_no = h.b1
    LEFT JOIN h p2 ON p2.doc_id = h.doc_id AND p2.block_no = h.b2 AND h.b2 > coalesce(h.b1, -1) LEFT JOIN h p3 ON p3.doc_id = h.doc_id AND p3.block_no = h.b3 AND h.b3 > coalesce(h.b2, -1) AND h.b3 > coalesce(h.b1, -1)""")
def section_path(spark, sf):
    return L.section_path(L.extract_blocks(D.rich(spark, sf))).select("doc_id", "block_no", F.array_join("section", " / ").alias("section"))


_SECTIONED = _KINDS + """, h AS (SELECT *, lower(trim(text)) AS t, max(CASE WHEN level = 1 THEN block_no END) OVER w AS b1, max(CASE WHEN level = 2 THEN block_no END) OVER w AS b2, max(CASE WHEN level = 3 THEN block_no END) OVER w AS b3
        FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
    s AS (SELECT h.doc_id, h.block_no, h.kind, h.text, list_filter([p1.t, p2.t, p3.t], lambda x: x IS NOT NULL) AS section FROM h LEFT JOIN h p1 ON p1.doc_id = h.doc_id AND p1.block_no = h.b1
    LEFT JOIN h p2 ON p2.doc_id = h.doc_id AND p2.block_no = h.b2 AND h.b2 > coalesce(h.b1, -1) LEFT JOIN h p3 ON p3.doc_id = h.doc_id AND p3.block_no = h.b3 AND h.b3 > coalesce(h.b2, -1) AND h.b3 > coalesce(h.b1, -1)),
    nodes AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, kind, section ORDER BY block_no) - 1 AS INTEGER) AS ordinal FROM s)"""


def nodes(docs):
    """Blocks with section, ordinal, locator and hash: what versions are compared by."""
    n = L.ordinals(L.section_path(L.extract_blocks(docs)))
    return n.withColumn("locator", T.locator_key(F.col("kind"), F.col("section"), F.col("ordinal"))).withColumn("hash", F.sha2(F.concat_ws("|", "kind", T.normalize_ws(F.col("text"))), 256))


_LOCATOR = "kind || ':[' || array_to_string(list_transform(section, lambda x: '\"' || replace(replace(x, '\\', '\\\\'), '\"', '\\\"') || '\"'), ',') || ']:' || ordinal"
_HASH = "sha256(kind || '|' || trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query(f"{_SECTIONED} SELECT doc_id, block_no, ordinal, {_LOCATOR} AS locator, {_HASH} AS hash FROM nodes")
def locator_keys(spark, sf):
    return nodes(D.rich(spark, sf)).select("doc_id", "block_no", "ordinal", "locator", "hash")


@query(f"""{_FENCED} SELECT f.doc_id, f.first, regexp_extract(a.line, '^```(\\S*)', 1) AS language, b.line AS content, sha256(b.line) AS content_hash FROM fences f
    JOIN lines a ON a.doc_id = f.doc_id AND a.line_no = f.first JOIN lines b ON b.doc_id = f.doc_id AND b.line_no = f.first + 1""")
def extract_code(spark, sf):
    from textloom.operators import extract as E

    return E.extract_code(D.rich(spark, sf)).select("doc_id", "first", "language", "content", F.sha2("content", 256).alias("content_hash"))


@query(f"""{_LINES}, o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS start FROM lines)
    SELECT doc_id, line_no, start + strpos(line, '](') AS "offset", line_no + 1 AS line, strpos(line, '](') + 1 AS "column" FROM o WHERE strpos(line, '](') > 0""")
def line_col(spark, sf):
    lines = L.line_offsets(D.rich(spark, sf))
    at = F.instr("line", "](")
    matches = lines.filter(at > 0).select("doc_id", "line_no", (F.col("start") + at).alias("offset"))
    return L.line_col(matches, lines)


@query(f"{_KINDS} SELECT doc_id, line_no FROM kinds WHERE kind <> 'code'")
def outside_ranges(spark, sf):
    rich = D.rich(spark, sf)
    return L.outside_ranges(L.explode_lines(rich).select("doc_id", "line_no"), L.fence_ranges(rich))


@query(f"{_LINES}, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - row_number() OVER (PARTITION BY doc_id, line LIKE '-%' ORDER BY line_no) AS g FROM lines) SELECT doc_id, min(line_no) AS first, count(*) AS n, line LIKE '-%' AS listed FROM g GROUP BY doc_id, g, line LIKE '-%'")
def runs(spark, sf):
    r = L.runs(L.explode_lines(D.rich(spark, sf)).withColumn("listed", F.startswith("line", F.lit("-"))), ["doc_id"], "line_no", F.col("listed"))
    return r.groupBy("doc_id", "run", "listed").agg(F.min("line_no").alias("first"), F.count(F.lit(1)).alias("n")).drop("run")
