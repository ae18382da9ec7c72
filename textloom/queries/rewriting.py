"""Links written back into whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import linkrewrite as W
from textloom.queries import query
from textloom.queries.transform import _CANON, _FILTERED
from textloom.runtime import materialize
from textloom.sources import derived as D

#: Slugs end in a digit: 0 is in no index, 1 twice, the others once.
_SITE = "https://site.example.com/"
_LINKED = f"""{D.with_ctes('lines')}, s AS (SELECT doc_id, line_no, line, regexp_extract(line, '\\]\\(\\./([^)]*)\\.md#part\\)', 1) AS slug, instr(line, '[') AS place FROM lines),
    r AS (SELECT *, CASE WHEN slug = '' OR slug LIKE '%1' THEN line ELSE replace(line, './' || slug || '.md#part', CASE WHEN slug LIKE '%0' THEN '{_SITE}' || slug || '#part' ELSE 'https://docs.example.com/wiki/' || slug END) END AS written,
        CASE WHEN slug LIKE '%1' THEN 'ambiguous-link ./' || slug || '.md#part ' || (line_no + 1) || ':' || place END AS blocker, CASE WHEN slug LIKE '%0' THEN 'public-fallback ./' || slug || '.md#part ' || (line_no + 1) || ':' || place END AS warning FROM s)"""


def _index(spark, links):
    slugs = links.filter("url LIKE './%'").select(F.regexp_extract("url", r"\./(.*)\.md#part", 1).alias("slug")).distinct().filter("slug NOT LIKE '%0'")
    slugs = materialize(slugs, "slugs")
    one = slugs.select("slug", F.concat(F.lit("https://docs.example.com/wiki/"), "slug").alias("url"))
    return one.union(slugs.filter("slug LIKE '%1'").select("slug", F.concat(F.lit("https://docs.example.com/other/"), "slug")))


@query(f"{_LINKED} SELECT doc_id, sha256(string_agg(written, chr(10) ORDER BY line_no)) AS text_hash, coalesce(string_agg(blocker, '|' ORDER BY line_no) FILTER (WHERE slug <> ''), '') AS blockers, coalesce(string_agg(warning, '|' ORDER BY line_no) FILTER (WHERE slug <> ''), '') AS warnings FROM r GROUP BY doc_id")
def rewrite_links(spark, sf):
    docs = D.rich(spark, sf)
    out = W.rewrite_links(docs, _index(spark, W.document_links(docs)), spark.createDataFrame([], "alias string, target string"), _SITE)
    return out.select("doc_id", F.sha2("text", 256).alias("text_hash"), F.array_join("blockers", "|").alias("blockers"), F.array_join("warnings", "|").alias("warnings"))


@query(f"""{_LINKED}, t AS (SELECT doc_id, list(line ORDER BY line_no) AS ls FROM lines GROUP BY doc_id), l AS (SELECT doc_id, line_no, line, CAST(coalesce(list_sum(list_transform(ls[:line_no], lambda x: length(x) + 1)), 0) AS BIGINT) AS before FROM lines JOIN t USING (doc_id)),
    m AS (SELECT doc_id, line_no, line, before, unnest(regexp_extract_all(line, '\\[[^\\]]+\\]\\(([^)\\s]+)\\)', 1)) AS url FROM l WHERE starts_with(line, 'See ['))
    SELECT doc_id, line_no + 1 AS line, url, before + instr(line, '](' || url) + 1 AS start, before + instr(line, '](' || url) + 1 + length(url) AS stop FROM m""")
def document_links(spark, sf):
    return W.document_links(D.rich(spark, sf)).select("doc_id", "line", "url", "start", "stop")


@query(f"""{_LINKED}, d AS (SELECT doc_id, {_CANON.format(c=_FILTERED.format(c="string_agg(written, chr(10) ORDER BY line_no)"))} AS draft, coalesce(string_agg(blocker, '|' ORDER BY line_no) FILTER (WHERE slug <> ''), '') AS blockers FROM r GROUP BY doc_id)
    SELECT doc_id, CASE WHEN blockers = '' THEN sha256(draft) END AS draft_hash, blockers FROM d""")
def link_drafts(spark, sf):
    docs = materialize(D.rich(spark, sf), "rich")
    out = W.link_drafts(docs, "alpha", ["alpha", "beta"], _index(spark, W.document_links(docs)), spark.createDataFrame([], "alias string, target string"), _SITE)
    return out.select("doc_id", "draft_hash", F.array_join("blockers", "|").alias("blockers"))
