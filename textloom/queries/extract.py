"""Constructs as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import compare as C
from textloom.operators import extract as E
from textloom.operators import lines as L
from textloom.queries import query
from textloom.queries.lines import _KINDS
from textloom.sources import derived as D

_FREE = _KINDS + ", free AS (SELECT doc_id, line_no, line FROM kinds WHERE kind <> 'code')"


@query(_FREE + """, m AS (SELECT doc_id, line_no, line, unnest(regexp_extract_all(line, '!\\[[^\\]]*\\]\\([^)\\s]+\\)')) AS m FROM free)
    SELECT doc_id, line_no, regexp_extract(m, '^!\\[([^\\]]*)', 1) AS alt, regexp_extract(m, '\\(([^)]+)\\)$', 1) AS url, trim(line) = m AS standalone FROM m""")
def extract_images(spark, sf):
    return E.extract_images(D.rich(spark, sf))


@query(_FREE + """, m AS (SELECT doc_id, line_no, unnest(range(len(a))) AS occ, unnest(a) AS m FROM (SELECT doc_id, line_no, regexp_extract_all(line, '\\[[^\\]]+\\]\\([^)\\s]+\\)') AS a FROM free WHERE NOT starts_with(line, '![')))
    SELECT doc_id, line_no, occ, regexp_extract(m, '^\\[([^\\]]*)', 1) AS label, regexp_extract(m, '\\(([^)]+)\\)$', 1) AS url FROM m""")
def extract_links(spark, sf):
    return E.extract_links(D.rich(spark, sf))


_INLINE = E.inline_pattern().replace("'", "''")


@query(_FREE + f""", l AS (SELECT doc_id, line_no, regexp_extract_all(line, '{_INLINE}') AS t, string_split(regexp_replace(line, '{_INLINE}', chr(1), 'g'), chr(1)) AS g FROM free WHERE NOT contains(line, chr(1))),
    r AS (SELECT doc_id, line_no, unnest(range(len(g) + len(t))) AS i, t, g FROM l), p AS (SELECT doc_id, line_no, i, CASE WHEN i % 2 = 0 THEN g[i // 2 + 1] END AS gap, CASE WHEN i % 2 = 1 THEN t[i // 2 + 1] END AS m FROM r),
    v AS (SELECT doc_id, line_no, i, CASE WHEN m IS NULL OR m[1] = '\\' THEN 'text' WHEN m[1] = '`' THEN 'code' WHEN m[1] = '=' THEN 'highlight' WHEN starts_with(m, '**') THEN 'bold' WHEN m[1] = '*' THEN 'italic' ELSE 'link' END AS kind,
        CASE WHEN m IS NULL THEN gap WHEN m[1] = '\\' THEN m[2:2] WHEN m[1] = '[' THEN m[2:strpos(m, '](') - 1] WHEN m[1] = '=' OR starts_with(m, '**') THEN m[3:-3] ELSE m[2:-2] END AS value, CASE WHEN m[1] = '[' THEN m[strpos(m, '](') + 2:-2] END AS url FROM p)
    SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) - 1 AS pos, kind, value, url FROM v WHERE value <> ''""")
def inline_runs(spark, sf):
    return E.inline_runs(E.unprotected_lines(D.rich(spark, sf)))


@query(_KINDS + """, t AS (SELECT doc_id, block_no, string_split(text, chr(10)) AS ls FROM blocks WHERE kind = 'table'),
    r AS (SELECT doc_id, block_no, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM t WHERE regexp_matches(ls[2], '^\\| --- '))
    SELECT doc_id, block_no, CASE WHEN i = 0 THEN 0 ELSE i - 1 END AS row_no, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(trim(line), '^\\|', ''), '\\|$', ''), '|'), lambda x: trim(x)), '|') AS cells FROM r WHERE i <> 1""")
def pipe_tables(spark, sf):
    return E.pipe_tables(L.extract_blocks(D.rich(spark, sf))).select("doc_id", "block_no", "row_no", F.array_join("cells", "|").alias("cells"))


@query(_KINDS + """, t AS (SELECT doc_id, unnest(range(len(a))) AS table_no, unnest(a) AS t FROM (SELECT doc_id, regexp_extract_all(text, '<table>(.*?)</table>', 1) AS a FROM rich)),
    r AS (SELECT doc_id, table_no, unnest(range(len(a))) AS row_no, unnest(a) AS r FROM (SELECT doc_id, table_no, regexp_extract_all(t, '<tr>(.*?)</tr>', 1) AS a FROM t)),
    c AS (SELECT doc_id, table_no, row_no, list_transform(regexp_extract_all(r, '<t[hd]>(.*?)</t[hd]>', 1), lambda x: trim(x)) AS cells FROM r)
    SELECT doc_id, table_no, row_no, cells[1] AS row_key, array_to_string(cells, '|') AS cells, CASE WHEN count(*) OVER (PARTITION BY doc_id, table_no, cells[1]) > 1 THEN 'duplicate-key' ELSE '' END AS issues FROM c""")
def html_tables(spark, sf):
    return E.html_tables(D.rich(spark, sf)).withColumn("cells", F.array_join("cells", "|")).withColumn("issues", F.array_join("issues", ","))


@query(_FREE + """ SELECT f.doc_id, f.line_no AS first, f.line_no + 2 AS last, 'note' AS type, '' AS title, l.line AS content, CAST(NULL AS VARCHAR) AS blocker FROM free f JOIN lines l ON l.doc_id = f.doc_id AND l.line_no = f.line_no + 1 WHERE f.line = ':::note'""")
def admonitions(spark, sf):
    return E.admonitions(D.rich(spark, sf))


@query(_FREE + """, d AS (SELECT l.doc_id, l.line_no, b.line FROM lines l JOIN lines b ON b.doc_id = l.doc_id AND b.line_no = l.line_no + 1 WHERE l.line = '<div class="alert note">')
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS occ, 'note' AS type, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS body, CASE WHEN trim(line) = '' THEN 'empty' ELSE '' END AS issues FROM d""")
def div_callouts(spark, sf):
    return E.div_callouts(D.rich(spark, sf)).withColumn("issues", F.array_join("issues", ","))


@query(_FREE + """, m AS (SELECT doc_id, line_no, line, code, regexp_extract_all(line, p) AS t, string_split(regexp_replace(line, p, chr(1), 'g'), chr(1)) AS g FROM free, (VALUES ('import', '^import\\s+.+\\s+from\\s+["'']'), ('component', '^\\s*</?[A-Z][A-Za-z]*\\b'), ('directive', '^\\s*:::'), ('expression', '\\{\\{[^}]*\\}\\}')) v(code, p) WHERE regexp_matches(line, p)),
    i AS (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM m)
    SELECT doc_id, line_no + 1 AS line, CAST(length(array_to_string(g[:i], '')) + length(array_to_string(t[:i - 1], '')) + 1 AS INTEGER) AS "column", code FROM i""")
def find_unsupported(spark, sf):
    return E.find_unsupported(D.rich(spark, sf))


@query(_FREE + """, t AS (SELECT doc_id, line_no, CASE WHEN trim(line) = '<Steps>' THEN 1 ELSE -1 END AS step FROM free WHERE trim(line) IN ('<Steps>', '</Steps>')),
    d AS (SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY line_no) AS depth FROM t)
    SELECT doc_id, max(depth) AS deepest, min(depth) AS lowest, sum(step) AS open, max(depth) <= 1 AND min(depth) >= 0 AND sum(step) = 0 AS paired FROM d GROUP BY doc_id""")
def pair_depth(spark, sf):
    return C.pair_depth(E.component_tokens(D.rich(spark, sf), "Steps"), ["doc_id"], "line_no", F.col("step"))


@query(_FREE + """, n AS (SELECT doc_id, unnest(regexp_extract_all(line, '</?([A-Z][A-Za-z]*)\\b', 1)) AS name FROM free UNION ALL SELECT doc_id, ':::' || unnest(regexp_extract_all(line, '^\\s*:::\\s*([A-Za-z]+)', 1)) FROM free)
    SELECT doc_id, name, count(*) AS n, CASE WHEN name IN ('Steps', ':::note') THEN 'known' ELSE 'unknown' END AS status FROM n GROUP BY doc_id, name""")
def component_inventory(spark, sf):
    return E.component_inventory(D.rich(spark, sf), ["Steps", ":::note"])


@query(f"""{D.with_ctes('lines')}, v AS (SELECT doc_id, line_no, line, regexp_extract(line, '\\{{\\{{var\\.([\\w-]+)\\}}\\}}', 1) AS n FROM lines)
    SELECT doc_id, coalesce(string_agg(DISTINCT 'var.' || n, ',' ORDER BY 'var.' || n) FILTER (WHERE length(n) % 2 = 1), '') AS missing, sha256(string_agg(CASE WHEN n <> '' AND length(n) % 2 = 0 THEN replace(line, '{{{{var.' || n || '}}}}', upper(n)) ELSE line END, chr(10) ORDER BY line_no)) AS text_hash FROM v GROUP BY doc_id""")
def substitute_variables(spark, sf):
    rich = D.rich(spark, sf)
    names = rich.select(F.explode(F.regexp_extract_all("text", F.lit(r"\{\{var\.([\w-]+)\}\}"), F.lit(1))).alias("n")).distinct()
    known = names.filter("length(n) % 2 = 0").select(F.concat(F.lit("var."), "n").alias("name"), F.upper("n").alias("value"))
    out = E.substitute_variables(rich, known)
    return out.select("doc_id", "missing", F.sha2("text", 256).alias("text_hash"))


@query(_KINDS + """, f AS (SELECT doc_id, line_no, CASE line_no % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'a1' WHEN 2 THEN 'loop1' ELSE 'python' END AS language FROM lines WHERE line = '```python')
    SELECT doc_id, line_no AS first, language, CASE language WHEN 'py' THEN 'python' WHEN 'a1' THEN 'python' WHEN 'python' THEN 'python' END AS resolved, CASE language WHEN 'loop1' THEN 'cycle' END AS issue FROM f""")
def resolve_language(spark, sf):
    codes = E.extract_code(D.rich(spark, sf))
    language = F.when(F.col("first") % 4 == 0, "py").when(F.col("first") % 4 == 1, "a1").when(F.col("first") % 4 == 2, "loop1").otherwise("python")
    aliases = spark.createDataFrame([("py", "python"), ("a1", "a2"), ("a2", "a3"), ("a3", "py"), ("loop1", "loop2"), ("loop2", "loop1")], "alias string, target string")
    return E.resolve_language(codes.select("doc_id", "first", language.alias("language")), aliases, ["python", "bash"])
