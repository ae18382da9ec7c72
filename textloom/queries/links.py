"""Link resolution, freshness and replacement."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import links as K
from textloom.queries import query
from textloom.runtime import table
from textloom.sources import derived as D

_INDEX = D.with_ctes("link_index")


def _links(spark, sf):
    links = D.page_links(spark, sf)
    index = D.link_index(links)
    slugged = links.select("page_id", "occ", "url", F.regexp_replace("url", "^/+", "").alias("slug"))
    slugs = links.select(F.regexp_replace("url", "^/+", "").alias("slug")).distinct()
    aliases = slugs.filter("length(slug) % 10 = 4").select(F.col("slug").alias("alias"), F.substring("slug", 1, 1).alias("x")).join(index.groupBy(F.substring("slug", 1, 1).alias("x")).agg(F.min("slug").alias("target")), "x").select("alias", "target")
    return slugged, index, aliases


_RESOLVED = _INDEX + """, cand AS (SELECT slug, count(DISTINCT url) AS n, min(url) AS u, string_agg(DISTINCT url, ',' ORDER BY url) AS urls FROM link_index GROUP BY slug), al AS (SELECT s.slug AS a, t.target FROM slugs s JOIN (SELECT substr(slug, 1, 1) AS x, min(slug) AS target FROM link_index GROUP BY 1) t ON substr(s.slug, 1, 1) = x WHERE length(s.slug) % 10 = 4),
    l AS (SELECT page_id, occ, url, regexp_replace(url, '^/+', '') AS slug FROM page_links),
    resolved AS (SELECT l.*, CASE WHEN coalesce(d.n, v.n) > 1 THEN 'ambiguous' WHEN coalesce(d.n, v.n) = 1 THEN 'index' ELSE 'public' END AS source, CASE WHEN coalesce(d.n, v.n) > 1 THEN NULL WHEN d.n IS NOT NULL THEN d.u WHEN v.n IS NOT NULL THEN v.u ELSE 'https://site.example.org/' || l.slug END AS resolved
        FROM l LEFT JOIN cand d ON d.slug = l.slug LEFT JOIN al ON al.a = l.slug LEFT JOIN cand v ON v.slug = al.target)"""


def _resolved(spark, sf):
    links, index, aliases = _links(spark, sf)
    return K.resolve_links(links, index, aliases, "https://site.example.org/")


@query(_RESOLVED + " SELECT slug, n AS n_urls, u AS url, urls FROM cand")
def index_candidates(spark, sf):
    return K.index_candidates(_links(spark, sf)[1])


@query(_RESOLVED + " SELECT slug, url, placement FROM link_index WHERE slug <> ''")
def scan_link_index(spark, sf):
    _, index, _ = _links(spark, sf)
    noise = index.withColumn("placement", F.lit("draft")).unionByName(index.withColumn("url", F.lit("ftp://x"))).unionByName(index)
    return K.scan_link_index(index.unionByName(noise), ["page"])


@query(_RESOLVED + " SELECT * FROM resolved")
def resolve_links(spark, sf):
    return _resolved(spark, sf)


@query(_RESOLVED + " SELECT page_id, count(*) FILTER (WHERE source = 'index') AS index, count(*) FILTER (WHERE source = 'public') AS public, count(*) FILTER (WHERE source = 'ambiguous') AS ambiguous, 0 AS unresolved FROM resolved GROUP BY page_id")
def link_summary(spark, sf):
    return K.link_summary(_resolved(spark, sf), ["page_id"])


@query(_RESOLVED + " SELECT page_id, sha256(string_agg(concat_ws(' ', url, resolved), chr(10) ORDER BY concat_ws(' ', url, resolved))) AS fingerprint FROM resolved GROUP BY page_id")
def links_fingerprint(spark, sf):
    return K.links_fingerprint(_resolved(spark, sf), ["page_id"], "url", "resolved")


@query(_RESOLVED + " SELECT page_id, string_agg(DISTINCT slug, ',' ORDER BY slug) AS dependencies FROM resolved GROUP BY page_id")
def sorted_dependencies(spark, sf):
    return K.sorted_dependencies(_resolved(spark, sf), ["page_id"], "slug")


@query("""WITH q AS (SELECT event_id, CAST(user_id % 50 AS VARCHAR) AS fingerprint, ts FROM events WHERE event_type = 'click'), s AS (SELECT event_id AS snapshot_id, CAST(user_id % 50 AS VARCHAR) AS fingerprint, ts AS at FROM events WHERE event_type <> 'click'),
    j AS (SELECT q.event_id, q.fingerprint, q.ts, max(s.at) AS fetched_at, arg_max(CAST(snapshot_id AS VARCHAR), (s.at, CAST(snapshot_id AS VARCHAR))) AS snapshot_id FROM q LEFT JOIN s ON s.fingerprint = q.fingerprint AND s.at <= q.ts GROUP BY ALL)
    SELECT event_id, fingerprint, snapshot_id, CASE WHEN ts < fetched_at + INTERVAL 1 HOUR THEN 'fresh' WHEN event_id % 3 = 0 THEN 'live' WHEN fetched_at IS NOT NULL THEN 'stale' ELSE 'none' END AS state FROM j""")
def index_as_of(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("user_id") % 50).cast("string").alias("fingerprint"), "ts", "event_type")
    requests = rows.filter("event_type = 'click'").drop("event_type")
    snapshots = rows.filter("event_type <> 'click'").select("fingerprint", F.col("ts").alias("fetched_at"), F.col("event_id").alias("snapshot_id"))
    return K.index_as_of(requests, snapshots, "1 HOUR", F.col("event_id") % 3 == 0).select("event_id", "fingerprint", "snapshot_id", "state")


@query(f"{D.with_ctes('rich')} SELECT doc_id, replace(text, '.md#part)', '.md)') AS text FROM rich")
def apply_replacements(spark, sf):
    rich = D.rich(spark, sf)
    at = lambda i: F.aggregate(F.slice(F.col("gaps"), F.lit(1), i + 1), F.lit(0), lambda n, g: n + F.length(g)) + i * 9
    cuts = rich.select("doc_id", F.split("text", r"\.md#part\)").alias("gaps")).filter("size(gaps) > 1").select("doc_id", F.explode(F.transform(F.expr("sequence(0, size(gaps) - 2)"), at)).alias("start"))
    return K.apply_replacements(rich, cuts.select("doc_id", "start", (F.col("start") + 9).alias("stop"), F.lit(".md)").alias("value")))
