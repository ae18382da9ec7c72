"""Links against an index: candidates, resolution, freshness, replacement in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import materialize, sized_broadcast

#: An index of at most so many slugs may be broadcast; a larger one is joined by shuffle.
MAX_BROADCAST_SLUGS = 200_000


def scan_link_index(records: DataFrame, accepted: list[str], slug: str = "slug", url: str = "url", placement: str = "placement") -> DataFrame:
    """slug, url, placement of valid records, once each."""
    rows = records.select(F.col(slug).alias("slug"), F.col(url).alias("url"), F.col(placement).alias("placement"))
    return rows.filter(F.col("placement").isin(accepted) & (F.coalesce("slug", F.lit("")) != "") & F.col("url").rlike("^https://")).distinct()


def index_candidates(index: DataFrame) -> DataFrame:
    """Per slug: number of distinct URLs, the smallest, and all of them in order."""
    return index.groupBy("slug").agg(F.count_distinct("url").alias("n_urls"), F.min("url").alias("url"), F.array_join(F.array_sort(F.collect_set("url")), ",").alias("urls"))


def resolve_links(links: DataFrame, index: DataFrame, aliases: DataFrame, public_base: str | None) -> DataFrame:
    """Links (with slug) plus ``source`` and ``resolved``.

    A direct slug wins over its alias. One URL resolves, several are ambiguous, none falls back to the
    public site or stays unresolved. The index is one row per slug before it is joined.
    """
    cand = index_candidates(index).select("slug", "n_urls", "url")
    direct = sized_broadcast(cand.select("slug", F.col("n_urls").alias("n1"), F.col("url").alias("u1")), MAX_BROADCAST_SLUGS)
    via = sized_broadcast(aliases.join(cand, aliases.target == cand.slug).select(F.col("alias").alias("slug"), F.col("n_urls").alias("n2"), F.col("url").alias("u2")), MAX_BROADCAST_SLUGS)
    j = links.join(direct, "slug", "left").join(via, "slug", "left")
    n, u = F.coalesce("n1", "n2"), F.when(F.col("n1").isNotNull(), F.col("u1")).otherwise(F.col("u2"))
    fallback = F.lit(None).cast("string") if public_base is None else F.concat(F.lit(public_base), F.col("slug"))
    source = F.when(n > 1, "ambiguous").when(n == 1, "index").when(fallback.isNotNull(), "public").otherwise("unresolved")
    resolved = F.when(n > 1, F.lit(None)).when(n == 1, u).otherwise(fallback)
    return j.select(*links.columns, source.alias("source"), resolved.alias("resolved"))


def link_summary(resolved: DataFrame, by: list[str]) -> DataFrame:
    kinds = ("index", "public", "ambiguous", "unresolved")
    return resolved.groupBy(*by).agg(*(F.count_if(F.col("source") == k).alias(k) for k in kinds))


def links_fingerprint(resolved: DataFrame, by: list[str], url: str, to: str) -> DataFrame:
    """Hash of a document's resolved links, whatever their order."""
    pair = F.concat_ws(" ", url, to)
    return resolved.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), "\n"), 256).alias("fingerprint"))


def index_as_of(requests: DataFrame, snapshots: DataFrame, ttl: str, live: Column) -> DataFrame:
    """Per request the newest snapshot of its fingerprint not after it, and whether it may be used.

    Younger than ``ttl``: fresh. Else the live index where there is one, else the old one with a warning.
    Both sides stand in one order of fingerprint and time, cut into ranges. Inside a range the last snapshot is carried
    along; from range to range one row for each goes on. No pairs are made, and one fingerprint may fill many ranges.
    """
    kept = F.struct(F.col("fetched_at").cast("timestamp").alias("fetched_at"), F.col("snapshot_id").cast("string").alias("snapshot_id"))
    asked = requests.select("fingerprint", F.col("ts").cast("timestamp").alias("t"), F.lit(1).alias("turn"), F.struct(*requests.columns).alias("r"), F.lit(None).cast("struct<fetched_at:timestamp,snapshot_id:string>").alias("s"))
    seen = snapshots.select("fingerprint", F.col("fetched_at").cast("timestamp").alias("t"), F.lit(0).alias("turn"), kept.alias("s"))
    line = asked.unionByName(seen, allowMissingColumns=True).repartitionByRange("fingerprint", "t", "turn").withColumn("part", F.spark_partition_id())
    line = materialize(line, "as-of")
    inside = Window.partitionBy("part", "fingerprint").orderBy("t", "turn", "s.snapshot_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("f").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, at most
    runs = line.groupBy("part", F.col("fingerprint").alias("f")).agg(F.max("s").alias("last")).select("f", F.col("part").alias("p"), F.max("last").over(before).alias("earlier"))
    carried = line.withColumn("own", F.last("s", ignorenulls=True).over(inside)).filter("turn = 1")
    found = carried.join(runs, (F.col("part") == F.col("p")) & F.col("fingerprint").eqNullSafe(F.col("f"))).withColumn("s", F.coalesce("own", "earlier"))
    newest = found.select("r.*", "s.fetched_at", "s.snapshot_id")
    fresh = F.col("ts") < F.col("fetched_at") + F.expr(f"INTERVAL {ttl}")
    return newest.withColumn("state", F.when(F.coalesce(fresh, F.lit(False)), "fresh").when(live, "live").when(F.col("snapshot_id").isNotNull(), "stale").otherwise("none"))


def apply_replacements(docs: DataFrame, replacements: DataFrame) -> DataFrame:
    """Text with (start, stop, value) replacements, offsets from 0 in the original text, none overlapping.

    The text is cut once per replacement and joined again; earlier cuts shift nothing.
    """
    by_doc = replacements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "value"))).alias("rs"))
    j = docs.join(by_doc, "doc_id", "left")
    ends = F.transform("rs", lambda r: r["stop"])
    before = F.transform("rs", lambda r, i: F.concat(F.substring(F.col("text"), F.when(i == 0, 0).otherwise(F.get(ends, i - 1)) + 1, r["start"] - F.when(i == 0, 0).otherwise(F.get(ends, i - 1))), r["value"]))
    last = F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0))
    whole = F.concat(F.array_join(before, ""), F.substring(F.col("text"), last + 1, F.length("text")))
    return j.select("doc_id", F.when(F.col("rs").isNull(), F.col("text")).otherwise(whole).alias("text"))


def sorted_dependencies(deps: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values of a group in binary order, as one line."""
    return deps.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias("dependencies"))
