"""Authoring transforms over whole corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import extract as E
from textloom.operators import lines as L
from textloom.operators import transform as X
from textloom.queries import query
from textloom.queries.lines import _KINDS
from textloom.runtime import table
from textloom.sources import derived as D

_RICH = D.with_ctes("rich")
_LINES = D.with_ctes("lines")


@query(f"""{_KINDS}, w AS (SELECT doc_id, line_no, kind <> 'code' AND NOT starts_with(line, '#') AND NOT starts_with(line, 'See [') AND NOT starts_with(line, '![') AS free, starts_with(line, '#') AND kind <> 'code' AND regexp_matches(line, '\\bthe\\b') AS warns, line FROM kinds)
    SELECT doc_id, string_agg(CASE WHEN free THEN regexp_replace(line, '\\bthe\\b', 'the/THE', 'g') ELSE line END, chr(10) ORDER BY line_no) AS text, count(*) FILTER (WHERE warns) AS warnings FROM w GROUP BY doc_id""")
def rewrite_product(spark, sf):
    return X.rewrite_product(D.rich(spark, sf), "the", "the/THE")


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'A ' || o_orderpriority || ' and ' || o_orderpriority WHEN o_orderkey % 3 = 1 THEN 'A <include target="alpha">' || o_orderpriority || '</include> B' ELSE 'none' END AS text FROM orders""")
def restore_includes(spark, sf):
    p = F.col("o_orderpriority")
    local = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("A "), p, F.lit(" and "), p)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("A "), p, F.lit(" B"))).otherwise("none")
    remote = F.concat(F.lit('R <include target="alpha">'), p, F.lit("</include> S"))
    return X.restore_includes(table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), local.alias("local"), remote.alias("remote")))


@query(_KINDS + """, m AS (SELECT doc_id, line_no, unnest(range(len(a))) AS occ, unnest(a) AS m FROM (SELECT doc_id, line_no, regexp_extract_all(line, '\\[[^\\]]+\\]\\([^)\\s]+\\)') AS a FROM kinds WHERE kind <> 'code' AND NOT starts_with(line, '![')))
    SELECT doc_id, line_no, occ, regexp_extract(m, '^\\[([^\\]]*)', 1) AS label, regexp_extract(m, '\\(([^)]+)\\)$', 1) || CASE WHEN doc_id % 2 = 0 THEN '#r' ELSE '' END AS url FROM m WHERE contains(m, 'docs.example.com')""")
def restore_links(spark, sf):
    rich = D.rich(spark, sf)
    remote = rich.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(") here."), F.lit("#r) here."))).otherwise(F.col("text")))
    return X.restore_links(rich, remote, "example.com")


@query(f"{_RICH} SELECT doc_id, replace(text, '```python', '```py3') AS text FROM rich")
def canonical_fences(spark, sf):
    return X.canonical_fences(D.rich(spark, sf), {"python": "py3"})


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'a > **note**' || chr(10) || '> ' || o_orderpriority || ' b' WHEN 1 THEN 'a <callout type="odd">' || o_orderpriority || '</callout> b' ELSE 'plain' END AS text, CASE WHEN o_orderkey % 3 = 1 THEN 'unknown-type' ELSE '' END AS issues FROM orders""")
def canonical_callouts(spark, sf):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "Note").otherwise("odd")
    text = F.when(F.col("o_orderkey") % 3 == 2, "plain").otherwise(F.concat(F.lit('a <callout type="'), kind, F.lit('">'), "o_orderpriority", F.lit("</callout> b")))
    text = F.when(kind == "Note", F.replace(text, F.lit(">1"), F.lit("> 1"))).otherwise(text)
    return X.canonical_callouts(table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")), ["note"])


@query("""SELECT c_custkey AS doc_id, 'Hi ' || CASE c_custkey % 6 WHEN 0 THEN 'zero' WHEN 1 THEN 'one zero' WHEN 2 THEN 'two one zero' WHEN 3 THEN '{{> f3}}' WHEN 4 THEN '{{> f4}}' ELSE '{{> f5}}' END || '!' AS text, CASE c_custkey % 6 WHEN 3 THEN 'f3:cycle f3 > f4 > f3' WHEN 4 THEN 'f4:cycle f4 > f3 > f4' WHEN 5 THEN 'f5:missing f5 > f6 > gone' ELSE '' END AS unresolved FROM customer""")
def expand_fragments(spark, sf):
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("Hi {{> f"), (F.col("c_custkey") % 6).cast("string"), F.lit("}}!")).alias("text"))
    parts = [("f0", "zero"), ("f1", "one {{> f0}}"), ("f2", "two {{>f1}}"), ("f3", "{{> f4}}"), ("f4", "{{> f3}}"), ("f5", "{{> f0}} {{> f6}} {{> f3}}"), ("f6", "{{> gone}}")]
    return X.expand_fragments(docs, spark.createDataFrame(parts, "name string, text string"))


@query(f"""{D.with_ctes('tbl_base')}, r AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM c3 THEN 1 ELSE 0 END) OVER (PARTITION BY table_key ORDER BY row_key) AS run FROM (SELECT *, lag(c3) OVER (PARTITION BY table_key ORDER BY row_key) AS before FROM tbl_base)),
    g AS (SELECT table_key, run, min(c3) || ':' || string_agg(CAST(CAST(c1 AS BIGINT) AS VARCHAR), '' ORDER BY row_key) AS line FROM r GROUP BY 1, 2) SELECT table_key AS block_id, sha256(string_agg(line, '|' ORDER BY run)) AS hash FROM g GROUP BY 1""")
def block_hash(spark, sf):
    base = D.tables(spark, sf)[0]
    return X.block_hash(base.select(F.col("table_key").alias("block_id"), F.col("row_key").alias("pos"), F.col("c3").alias("style"), F.col("c1").cast("long").cast("string").alias("content")))


@query(_KINDS + " SELECT doc_id, block_no, sha256(CASE WHEN kind = 'code' THEN 'code|' || text || '|py' WHEN kind IN ('paragraph', 'heading', 'bullet', 'ordered') THEN 'text|' || kind || '|' || trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE kind || '|' || text END) AS hash FROM blocks")
def node_hash(spark, sf):
    blocks = L.extract_blocks(D.rich(spark, sf))
    return blocks.select("doc_id", "block_no", X.node_hash(F.col("kind"), F.col("text"), F.lit("py")).alias("hash"))


@query("SELECT o_orderkey, true AS same, o_orderkey % 2 <> 0 AS same_strict, trim(o_orderpriority) AS key FROM orders")
def cells_equiv(spark, sf):
    a = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("**"), "o_orderpriority", F.lit("**  \n"))).otherwise(F.col("o_orderpriority"))
    b = F.concat(F.lit(" "), "o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", X.cells_equiv(a, b, True).alias("same"), X.cells_equiv(a, b).alias("same_strict"), T.normalize_ws(b).alias("key"))


@query("SELECT o_custkey AS table_key, (n - 1) // 3 AS row_no, (n - 1) % 3 AS col_no, o_orderpriority AS content FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)")
def block_tables(spark, sf):
    from textloom.operators.compare import occurrence

    cells = occurrence(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"])
    return X.block_tables(cells.select(F.col("o_custkey").alias("table_key"), (F.col("occ") - 1).alias("n"), F.col("o_orderpriority").alias("content")), F.lit(3))


@query("SELECT 'o' || o_orderkey AS block_id, o_orderpriority AS name, CAST(o_custkey AS INTEGER) AS record_id FROM orders WHERE o_orderkey % 3 = 1")
def addon_resources(spark, sf):
    record = F.to_json(F.struct(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("id")))
    payload = F.to_json(F.struct(F.when(F.col("o_orderkey") % 3 == 1, "blk").otherwise("other").alias("type"), record.alias("record")))
    rows = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("block_id"), payload.alias("payload"))
    return X.addon_resources(rows, "payload", "blk")


@query(f"{_RICH} SELECT doc_id, regexp_replace(text, '(?s)<div class=\"alert note\">.*?</div>\\n?', '', 'g') AS text FROM rich")
def clean_selectors(spark, sf):
    return X.clean_selectors(D.rich(spark, sf), "alert")


@query("""WITH s AS (SELECT p_partkey AS k, 'a' || p_partkey AS asset FROM part) SELECT asset, 'element:script' AS issue FROM s WHERE k % 4 = 0 UNION ALL SELECT asset, 'external-reference' FROM s WHERE k % 4 = 1 UNION ALL SELECT asset, 'event-attribute' FROM s WHERE k % 4 = 2 UNION ALL SELECT asset, 'no-viewbox' FROM s WHERE k % 3 = 0""")
def svg_audit(spark, sf):
    k = F.col("p_partkey")
    head = F.when(k % 3 == 0, "<svg>").otherwise('<svg viewBox="0 0 1 1">')
    body = F.when(k % 4 == 0, "<script>x</script>").when(k % 4 == 1, '<path xlink:href="http://x"/>').when(k % 4 == 2, '<path onclick="x"/>').otherwise('<path href="#a"/>')
    return X.svg_audit(table(spark, sf, "part").select(F.concat(F.lit("a"), k.cast("string")).alias("asset"), F.concat(head, body, F.lit("</svg>")).alias("svg")), ["svg", "path", "g"])


@query("SELECT conv_id AS board, sha256(string_agg(turn || ':' || role, '|' ORDER BY turn)) AS hash, bool_or(role = 'system') AND bool_or(role = 'user') AS complete FROM conversations GROUP BY conv_id")
def board_hash(spark, sf):
    return X.board_hash(table(spark, sf, "conversations").select(F.col("conv_id").alias("board"), F.col("turn").alias("node_id"), F.col("role").alias("content")), ["system", "user"])


@query(_KINDS + """, m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '!\\[[^\\]]*\\]\\(([^)\\s]+)\\)', 1)) AS url FROM kinds WHERE kind <> 'code')
    SELECT doc_id, url, CASE length(url) % 4 WHEN 0 THEN 'paired' WHEN 1 THEN 'no-source' WHEN 2 THEN 'no-image' ELSE 'missing' END AS state FROM m""")
def discover_assets(spark, sf):
    images = E.extract_images(D.rich(spark, sf)).select("doc_id", "url", "standalone")
    stem = F.regexp_replace(F.regexp_replace("url", r"^\./", ""), r"\.png$", "")
    n = F.length("url") % 4
    files = images.select(F.explode(F.array_compact(F.array(F.when(n.isin(0, 1), F.concat(stem, F.lit(".png"))), F.when(n.isin(0, 2), F.concat(stem, F.lit(".svg")))))).alias("asset"))
    return X.discover_assets(images, files)


@query(_KINDS + " SELECT doc_id, line_no AS first, CASE WHEN line_no % 3 = 0 THEN 'py' ELSE 'python' END AS language FROM lines WHERE line = '```python'")
def carry_aliases(spark, sf):
    code = E.extract_code(D.rich(spark, sf)).select("doc_id", "first", "language")
    local = code.withColumn("language", F.when(F.col("first") % 3 == 0, "py").when(F.col("first") % 3 == 1, "bash").otherwise(F.col("language")))
    return X.carry_aliases(code, local, code, {"py": "python", "sh": "bash"})


_CANON = "regexp_replace(regexp_replace(regexp_replace({c}, '(?m)[ \\t]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_FILTERED = "regexp_replace(regexp_replace(regexp_replace({c}, '<include target=\"alpha\">([^<]*)</include>', '\\1', 'g'), '<exclude target=\"alpha\">[^<]*</exclude>', '', 'g'), '<include target=\"beta\">[^<]*</include>', '', 'g')"


@query(f"{_RICH}, d AS (SELECT doc_id, {_CANON.format(c=_FILTERED.format(c='text'))} AS draft FROM rich) SELECT doc_id, draft, sha256(draft) AS draft_hash, sha256({_CANON.format(c='draft')}) AS view_hash FROM d")
def build_drafts(spark, sf):
    return X.build_drafts(D.rich(spark, sf), "alpha", ["alpha", "beta"], "alpha", "beta")


@query(f"{_RICH}, d AS (SELECT doc_id, {_CANON.format(c=_FILTERED.format(c='replace(text, $$```python$$, $$```py3$$)'))} AS t FROM rich) SELECT doc_id, length(t) AS chars, sha256(t) AS hash FROM d")
def build_pulls(spark, sf):
    return X.build_pulls(D.rich(spark, sf), ["note"], {"python": "py3"}, "alpha", ["alpha", "beta"])
