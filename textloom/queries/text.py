"""Canonical text, keys, links and titles over whole corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import lines as L
from textloom.operators import transform as X
from textloom.queries import query
from textloom.queries.lines import _KINDS
from textloom.runtime import table
from textloom.sources import derived as D

_RICH = D.with_ctes("rich")
_LINES = D.with_ctes("lines")
_CANON = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\\r\\n', chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"{_RICH} SELECT doc_id, {_CANON.format(c='text')} AS markdown FROM rich")
def canonical_markdown(spark, sf):
    return D.rich(spark, sf).select("doc_id", T.canonical_markdown(F.col("text")).alias("markdown"))


@query(f"{_RICH} SELECT doc_id, sha256(text) AS source_hash, sha256({_CANON.format(c='text')}) AS canonical_hash FROM rich")
def content_hash(spark, sf):
    return D.rich(spark, sf).select("doc_id", T.content_hash(F.col("text")).alias("source_hash"), T.canonical_hash(F.col("text")).alias("canonical_hash"))


@query(f"{_LINES} SELECT doc_id, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS label, lower(trim(regexp_replace(regexp_extract(line, '^#+\\s+(.*)$', 1), '\\s+', ' ', 'g'))) AS heading FROM lines WHERE line LIKE '#%'")
def heading_keys(spark, sf):
    found = L.explode_lines(D.rich(spark, sf)).filter(F.startswith("line", F.lit("#")))
    return found.select("doc_id", "line_no", T.normalize_ws(F.col("line")).alias("label"), T.heading_key(F.regexp_extract("line", r"^#+\s+(.*)$", 1)).alias("heading"))


@query(f"""{_LINES} SELECT doc_id, line_no, CASE WHEN line = '| --- | :---: |' THEN '| --- | :---: |' ELSE regexp_replace(regexp_replace(line, '^(\\s*)\\d+[.)](\\s+)', '\\11.\\2'), chr(160), ' ', 'g') END AS line
    FROM lines""")
def canonical_lines(spark, sf):
    return L.explode_lines(D.rich(spark, sf)).select("doc_id", "line_no", T.canonical_line(F.col("line")).alias("line"))


@query(f"""{_RICH} SELECT doc_id, regexp_replace(regexp_extract(text, '^---\\n(?:title[^\\n]*\\n)(?:slug[^\\n]*\\n)---', 0), '\\s+$', '') AS frontmatter,
    trim(regexp_extract(text, '^---\\ntitle: ([^\\n]*)\\n', 1)) AS title, regexp_extract(text, '\\nslug: ([^\\n]*)\\n---', 1) AS slug,
    length(regexp_replace(regexp_replace(text, '^---\\n[^\\n]*\\n[^\\n]*\\n---\\n', ''), '^\\s+', '')) AS body_chars FROM rich""")
def split_frontmatter(spark, sf):
    parts = D.rich(spark, sf).select("doc_id", T.split_frontmatter(F.col("text")).alias("p")).withColumn("m", T.frontmatter_scalars(F.col("p.frontmatter")))
    return parts.select("doc_id", "p.frontmatter", F.try_element_at("m", F.lit("title")).alias("title"), F.try_element_at("m", F.lit("slug")).alias("slug"), F.length("p.body").cast("long").alias("body_chars"))


@query(f"""{_RICH} SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '<include target="alpha">([^<]*)</include>', '\\1', 'g'), '<exclude target="alpha">[^<]*</exclude>', '', 'g'), '<include target="beta">[^<]*</include>', '', 'g') AS text FROM rich""")
def filter_profile(spark, sf):
    return D.rich(spark, sf).select("doc_id", T.filter_profile(F.col("text"), "alpha", ["alpha", "beta"]).alias("text"))


@query(f"""{_RICH} SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '<include target="beta">[^<]*</include>'), lambda s: 'include:unknown:beta'), ';') AS warnings FROM rich""")
def profile_warnings(spark, sf):
    # a profile that knows one of the two targets
    return D.rich(spark, sf).select("doc_id", F.array_join(T.profile_warnings(F.col("text"), ["alpha"]), ";").alias("warnings"))


@query(f"""{_RICH} SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<include target="alpha">([^<]*)</include>', '\\1', 'g'), '<include target="beta">[^<]*</include>', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM rich""")
def collapse_includes(spark, sf):
    return D.rich(spark, sf).select("doc_id", T.collapse_includes(F.col("text"), "alpha", "beta").alias("text"))


@query(_KINDS + " SELECT doc_id, line_no, CASE WHEN kind = 'code' THEN line ELSE regexp_replace(line, '^( {0,3}#{1,6}\\s.*?)[ \\t]*\\\\?\\{#[A-Za-z0-9_-]+\\}[ \\t]*$', '\\1') END AS line FROM kinds")
def strip_heading_anchors(spark, sf):
    return X.strip_heading_anchors(D.rich(spark, sf))


_LINKS = f"{_LINES}, links AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '\\]\\(([^)\\s]+)\\)', 1)) AS url FROM lines)"


def _links(spark, sf):
    return L.explode_lines(D.rich(spark, sf)).select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))).alias("url"))


@query(f"""{_LINKS} SELECT doc_id, line_no, url, NOT regexp_matches(url, '^(#|/|[a-z][a-z0-9+.-]*:)') AS relative, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment,
    nullif(regexp_replace(regexp_extract(regexp_replace(url, '[#?].*$', ''), '([^/]*)/*$', 1), '\\.mdx?$', ''), '') AS slug, nullif(regexp_replace(regexp_extract(regexp_replace(url, '[#?].*$', ''), '([^/]*)/*$', 1), '\\.mdx?$', ''), '') AS file_slug FROM links""")
def link_parts(spark, sf):
    url = F.col("url")
    return _links(spark, sf).select("doc_id", "line_no", "url", T.is_relative_doc(url).alias("relative"), T.link_fragment(url).alias("fragment"), T.link_slug(url).alias("slug"), T.link_slug(url, "file").alias("file_slug"))


@query(f"""{_LINKS} SELECT doc_id, line_no, url, CASE WHEN regexp_matches(url, '^https://docs\\.example\\.com/wiki/[A-Za-z0-9_-]+$') THEN url END AS doc_url, CASE WHEN regexp_matches(url, '^https://docs\\.example\\.com/wiki/[A-Za-z0-9]') THEN 'wiki:' || regexp_extract(url, '/wiki/([A-Za-z0-9]+)', 1) END AS target,
    'https://site.example.org/' || regexp_replace(url, '^/', '') || '#top' AS public FROM links""")
def link_targets(spark, sf):
    url = F.col("url")
    target = T.parse_target(url, {"docx": "docx", "wiki": "wiki"})
    return _links(spark, sf).select("doc_id", "line_no", "url", T.valid_doc_url(url, ["example.com"], ["wiki", "docx"]).alias("doc_url"), F.concat(target["kind"], F.lit(":"), target["token"]).alias("target"), T.public_url(F.lit("https://site.example.org/"), url, F.lit("top")).alias("public"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN replace(replace(url, ':', '%3A'), '/', '%2F') ELSE 'see%20' || replace(replace(url, ':', '%3A'), '/', '%2F') END AS raw,
    CASE page_id % 3 WHEN 2 THEN 'see%20' || replace(replace(url, ':', '%3A'), '/', '%2F') ELSE url END AS link FROM pages""")
def normalize_links(spark, sf):
    coded = F.replace(F.replace("url", F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F"))
    raw = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, coded).otherwise(F.concat(F.lit("see%20"), coded))
    return table(spark, sf, "pages").select("page_id", raw.alias("raw"), T.normalize_link(raw).alias("link"))


@query(f"""{_RICH} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Given' ELSE coalesce(nullif(regexp_replace(regexp_extract(text, '(?m)^# +(\\S[^\\n]*)$', 1), '\\s+$', ''), ''), 'doc-' || doc_id) END AS title,
    CASE WHEN doc_id % 7 = 0 THEN 'option' WHEN regexp_matches(text, '(?m)^# +\\S') THEN 'first H1' ELSE 'file basename' END AS source FROM rich""")
def resolve_title(spark, sf):
    explicit = F.when(F.col("doc_id") % 7 == 0, F.lit(" Given "))
    path = F.concat(F.lit("docs/en/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return D.rich(spark, sf).select("doc_id", T.resolve_title(F.col("text"), path, explicit).alias("t")).select("doc_id", "t.title", "t.source")


@query(f"""{D.with_ctes('four')} SELECT doc_id, (CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 1 AND regexp_matches(l0, '^---\\n[^\\n]*\\n[^\\n]*\\n---\\n# +[^\\n]') THEN regexp_extract(l0, '^(---\\n[^\\n]*\\n[^\\n]*\\n---)\\n', 1) || chr(10) || regexp_replace(regexp_replace(regexp_replace(l0, '^---\\n[^\\n]*\\n[^\\n]*\\n---\\n', ''), '^# +[^\\n]+(\\n\\n?|$)', ''), '^\\s+', '') ELSE l0 END) AS text FROM four""")
def strip_matching_title(spark, sf):
    remote = F.when(F.col("doc_id") % 2 == 0, F.col("r1")).otherwise("# Another")
    return D.four_way(spark, sf).select("doc_id", T.strip_matching_title(F.col("l0"), remote, F.lit("none")).alias("text"))


_BLANKS = "trim(regexp_replace({c}, '[\\t-\\r \\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
_VISIBLE = _BLANKS.format(c="regexp_replace(line, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')")


@query(f"{_LINES} SELECT doc_id, line_no, {_VISIBLE} AS visible, {_VISIBLE} = {_BLANKS.format(c='line')} AS plain FROM lines")
def visible_text(spark, sf):
    line = F.col("line")
    return L.explode_lines(D.rich(spark, sf)).select("doc_id", "line_no", T.visible_text(line).alias("visible"), (T.visible_text(line) == T.normalize_ws(line)).alias("plain"))


@query("""SELECT o_orderkey, sha256('{"a":' || o_custkey || ',"b":"' || o_orderstatus || '","z":' || o_orderkey || '}') AS hash FROM orders""")
def stable_json_hash(spark, sf):
    js = T.stable_json({"z": F.col("o_orderkey"), "a": F.col("o_custkey"), "b": F.col("o_orderstatus")})
    return table(spark, sf, "orders").select("o_orderkey", F.sha2(js, 256).alias("hash"))


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN CAST(event_id AS VARCHAR) = 'r' || user_id ELSE event_id >= user_id END AS reached FROM events""")
def revision_reached(spark, sf):
    wanted = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("r"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", T.revision_reached(F.col("event_id").cast("string"), wanted).alias("reached"))


@query("SELECT page_id, 'a/c' || regexp_replace(regexp_extract(url, '^https?://[^/]+(.*)$', 1), '/+$', '') AS asset FROM pages")
def asset_keys(spark, sf):
    path = F.concat(F.lit("./a/b/../c//"), F.regexp_extract("url", r"^https?://[^/]+/*(.*)$", 1))
    return table(spark, sf, "pages").select("page_id", T.asset_key(path).alias("asset"))


@query(f"{_LINES}, marked AS (SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN '<<<<<<< mine' WHEN doc_id % 9 = 5 THEN 'x <<<<<<< mine' ELSE 'plain' END AS first FROM rich) SELECT doc_id, first = '<<<<<<< mine' AS conflicted FROM marked")
def conflict_markers(spark, sf):
    first = F.when(F.col("doc_id") % 9 == 4, "<<<<<<< mine").when(F.col("doc_id") % 9 == 5, "x <<<<<<< mine").otherwise("plain")
    return D.rich(spark, sf).select("doc_id", T.has_conflict_markers(F.concat_ws("\n", "text", first)).alias("conflicted"))


@query(f"{_LINES} SELECT doc_id, line_no, regexp_matches(trim(line), '^<include\\b[^>]*>$|^</include>$') AS boundary FROM lines WHERE contains(line, 'include')")
def include_boundaries(spark, sf):
    found = L.explode_lines(D.rich(spark, sf)).filter(F.contains("line", F.lit("include")))
    return found.select("doc_id", "line_no", T.is_include_boundary(F.col("line")).alias("boundary"))


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'note' WHEN 'click' THEN 'warning' ELSE CASE WHEN user_id % 2 = 0 THEN 'note' END END AS callout FROM events""")
def callout_types(spark, sf):
    icon = F.when(F.col("user_id") % 2 == 0, "blue").otherwise("none")
    return table(spark, sf, "events").select("event_id", T.callout_type(F.concat(F.lit("  "), F.upper("event_type")), icon, {"purchase": "note", "click": "warning"}, {"blue": "note", "red": "warning"}).alias("callout"))
