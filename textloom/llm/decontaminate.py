"""Benchmark decontamination as a prefix-filtered set join; DataFrame functions only (operator 10).

A window (13 consecutive words of an item; a shorter item is one window) must be contained whole, so of
its shingles ordered by rarity a prefix of one is necessary: the window's rarest shingle. One pass over the
texts finds the places of all shingles that windows have; rarity, the prefix join and the bounds (the place
in the window and the two lengths say where the window can lie) work on those places alone. Then the words
of the documents with a place left are fetched once and compared one by one.

The windows' shingles are broadcast while they have at most ``max_broadcast_rows`` rows, wider rows up to a
tenth of that. Of more shingles a Bloom filter of bounded size goes to the texts, and the places that pass it are joined by
shuffle. Words never do, but for documents with a place left when those are too many to broadcast, once each.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Null texts have no words, items
without words no windows; very long texts are taken whole. Repeated rows each get their row; items with
equal ids are one item. Of equally rare shingles the first in the window is its prefix, which changes no
result. Empty tables give no rows (documents) or no hits (benchmark). Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bits import filter_of, may_hold
from textloom.runtime import materialize, sized_broadcast

WINDOW = 13
SHINGLE = 4
MAX_BROADCAST_ROWS = 200_000
#: Of rows that hold a window's words, so many are as large.
WIDE_ROWS = 10
#: Bits of the filter of shingles where they are too many to broadcast: 64 MiB.
MAX_FILTER_BITS = 1 << 29
_NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, _NO_WORD), "")


def _key(words: Column, at: Column, k: int) -> Column:
    """Hash of the k words from a place on; the length keeps shingles of different k apart."""
    return F.xxhash64(F.lit(k), *(F.get(words, at + F.lit(i)) for i in range(k)))


def _row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of what a row holds: equal in every scan of the rows, and equal rows are decided alike."""
    held = F.coalesce(doc_id.cast("string"), F.lit("null")), text.cast("string")
    return F.struct(F.xxhash64(*held).alias("a"), F.xxhash64(F.lit(1), *held).alias("b"))


def windows_of(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """item_id, window (its words), k (words a shingle), at, key: every shingle of every window."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    wins = items.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("from")).select("item_id", F.expr(f"slice(words, `from` + 1, {window})").alias("window")).distinct()
    wins = wins.withColumn("k", F.least(F.size("window"), F.lit(shingle))).select("*", F.explode(F.sequence(F.lit(0), F.size("window") - F.col("k"))).alias("at"))
    key = reduce(lambda other, k: F.when(F.col("k") == k, _key(F.col("window"), F.col("at"), k)).otherwise(other), range(1, shingle), _key(F.col("window"), F.col("at"), shingle))
    return wins.withColumn("key", key)


def places(rows: DataFrame, keys: DataFrame, lengths: list[int], max_broadcast_rows: int) -> DataFrame:
    """uid, doc_id, n_words, at, key: where ``rows`` (uid, doc_id, text) have a shingle of the windows.

    A document's last row, at ``n_words``, stands for the document itself.
    """
    worded = rows.select("uid", "doc_id", words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    at = F.col("at")
    own = [F.when(at + k <= F.col("n_words"), _key(F.col("words"), at, k)) for k in lengths]
    own[0] = F.when(at == F.col("n_words"), F.lit(0).cast("long")).otherwise(own[0])
    rolled = worded.select("*", F.explode(F.expr("sequence(0, n_words)")).alias("at")).withColumn("key", F.explode(F.array(*own)) if len(own) > 1 else own[0]).drop("words")
    wanted = materialize(keys.unionByName(keys.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"))).distinct(), "wanted-shingles")
    n = wanted.count()
    if n > max_broadcast_rows:
        held = materialize(may_hold(rolled, *filter_of(wanted, n, MAX_FILTER_BITS)).select("uid", "doc_id", "n_words", "at", "key"), "shingle-candidates")
        # the rows that stand for documents share a key; they need no join
        return held.filter("at < n_words").join(wanted, "key", "left_semi").select(*held.columns).unionByName(held.filter("at = n_words"))
    return rolled.join(F.broadcast(wanted), "key", "left_semi").select("uid", "doc_id", "n_words", "at", "key")


def _found(rows: DataFrame, benchmark: DataFrame, window: int, shingle: int, max_broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """The documents (uid, doc_id, n_words), and of those with a hit uid, n_hit, n_items and items_sha256."""
    wins = materialize(windows_of(benchmark, window, shingle), "benchmark-windows")
    lengths = sorted(r["k"] for r in wins.select("k").distinct().collect()) or [shingle]
    seen = materialize(places(rows, wins.select("key"), lengths, max_broadcast_rows), "shingle-places")
    base, seen = seen.filter("at = n_words").select("uid", "doc_id", F.col("n_words").cast("long").alias("n_words")), seen.filter("at < n_words")
    rarity = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # a window whose rarest shingle is nowhere can't occur; one that many items share is looked for once
    ranked = wins.join(rarity, "key", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("at"), F.col("key"))).alias("rarest"))
    prefix = materialize(ranked.filter("rarest.n > 0").select("window", F.col("rarest.key").alias("key"), F.col("rarest.at").alias("shift")), "prefixes")
    start = F.col("at") - F.col("shift")
    near = seen.join(sized_broadcast(prefix, max_broadcast_rows // WIDE_ROWS), "key").filter((start >= 0) & (start + F.size("window") <= F.col("n_words")))
    near = materialize(near.select("uid", start.alias("start"), "window").distinct(), "window-places")
    texts = rows.select("uid", "text").join(sized_broadcast(near.select("uid").distinct(), max_broadcast_rows), "uid", "left_semi")
    held = texts.select("uid", words_of(F.col("text")).alias("words")).join(sized_broadcast(near, max_broadcast_rows // WIDE_ROWS), "uid").filter(F.expr("slice(words, start + 1, size(window)) = window"))
    hits = materialize(held.select("uid", "start", (F.col("start") + F.size("window")).alias("stop"), "window").distinct(), "window-hits")
    order = Window.partitionBy("uid").orderBy("start", "stop")
    covered = hits.select("uid", "start", "stop").distinct().withColumn("seen", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.greatest(F.col("stop") - F.greatest(F.col("start"), F.coalesce("seen", F.lit(0))), F.lit(0))
    n_hit = covered.groupBy("uid").agg(F.sum(fresh).cast("long").alias("n_hit"))
    item_of = wins.select("window", F.col("item_id").cast("string").alias("item")).distinct()
    items = hits.select("uid", "window").distinct().join(item_of, "window").select("uid", "item").distinct().groupBy("uid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    digests = items.select("uid", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return base, materialize(n_hit.join(digests, "uid"), "hit-documents")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = docs.select(_row_key(F.col("doc_id"), F.col("text")).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    base, found = _found(rows, benchmark, window, shingle, max_broadcast_rows)
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return base.join(sized_broadcast(found, max_broadcast_rows), "uid", "left").select(
        "doc_id", "n_words", n.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), _contaminated(n, F.col("n_words")).alias("contaminated"),
    )


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    held = docs.select(_row_key(F.col("doc_id"), F.col("text")).alias("uid"), row.alias("row"))
    rows = held.select("uid", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    base, found = _found(rows, benchmark, window, shingle, max_broadcast_rows)
    bad = base.join(sized_broadcast(found, max_broadcast_rows), "uid").filter(_contaminated(F.col("n_hit"), F.col("n_words"))).select("uid").distinct()
    return held.join(sized_broadcast(materialize(bad, "contaminated"), max_broadcast_rows), "uid", "left_anti").select("row.*")
