"""Scans, sinks, merges and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.operators import merge as M
from textloom.queries import query
from textloom.queries.status import _STATUS
from textloom.runtime import materialize, shared_dir, table
from textloom.sources import corpus as S
from textloom.sources import derived as D
from textloom.streaming import feeds

_FOUR = D.with_ctes("four")


def _folder(spark, label):
    return f"{shared_dir(spark)}/textloom-{label}-{uuid.uuid4().hex}"


@query("SELECT doc_id, 'current' AS version, length(text) AS chars FROM documents")
def scan_corpus(spark, sf):
    return S.scan_corpus(spark, f"{sf}/documents.parquet").select("doc_id", "version", F.length("text").cast("long").alias("chars"))


@query("""SELECT o_orderkey, 'o' || o_orderkey AS block_id, CAST(o_custkey % 9 AS INTEGER) AS block_type, CASE WHEN o_orderkey % 2 = 0 THEN 'x' || o_orderkey || ',y' ELSE 'z' END AS children, CAST(NULL AS VARCHAR) AS v, 0 AS nested FROM orders
    UNION ALL SELECT o_orderkey, 'y', 2, 'w', '1', 1 FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'w', NULL, '', CAST(o_custkey AS VARCHAR), 2 FROM orders WHERE o_orderkey % 2 = 0""")
def scan_blocks(spark, sf):
    inner = F.concat(F.lit('{"block_id":"y","block_type":2,"text":{"v":1},"children":[{"block_id":"w","text":{"v":'), F.col("o_custkey").cast("string"), F.lit("}}]}"))
    kids = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('["x'), F.col("o_orderkey").cast("string"), F.lit('",'), inner, F.lit("]"))).otherwise('["z"]')
    js = F.concat(F.lit('{"block_id":"o'), F.col("o_orderkey").cast("string"), F.lit('","block_type":'), (F.col("o_custkey") % 9).cast("string"), F.lit(',"children":'), kids, F.lit("}"))
    rows = table(spark, sf, "orders").select("o_orderkey", js.alias("raw"))
    return S.scan_blocks(rows, "raw").select("o_orderkey", "block_id", "block_type", F.array_join("children", ",").alias("children"), F.get_json_object("payload", "$.text.v").alias("v"), "nested")


@query(f"{D.with_ctes('receipts')} SELECT doc_id, version, draft_hash, remote_hash, CASE WHEN version >= 2 THEN dialect END AS dialect FROM receipts")
def scan_receipts(spark, sf):
    return S.scan_receipts(D.receipts(D.four_way(spark, sf))).select("doc_id", "version", "draft_hash", "remote_hash", "dialect")


@query(f"{D.with_ctes('receipts')} SELECT r.doc_id, version, CASE WHEN r.doc_id % 4 = 2 THEN 'no-base' WHEN sha256(r1) = remote_hash THEN 'verified' ELSE 'mismatch' END AS state, CASE WHEN r.doc_id % 4 <> 2 AND sha256(r1) = remote_hash THEN sha256(r1) END AS base_hash FROM receipts r JOIN four USING (doc_id)")
def verified_snapshots(spark, sf):
    four = D.four_way(spark, sf)
    receipts = D.receipts(four).withColumn("snapshot_hash", F.col("remote_hash"))
    out = S.verified_snapshots(receipts, four.filter("doc_id % 4 <> 2").select("doc_id", F.col("r1").alias("text")))
    return out.select("doc_id", "version", "state", F.sha2("base", 256).alias("base_hash"))


@query(f"{_FOUR} SELECT doc_id, CAST(5 AS INTEGER) AS version, sha256(l0) AS snapshot_hash FROM four")
def write_baseline(spark, sf):
    return S.write_baseline(D.four_way(spark, sf).select("doc_id", F.col("l0").alias("text")), _folder(spark, "baseline"))


@query(f"{_FOUR} SELECT count(*) AS written, 0 AS differing FROM four")
def write_snapshot(spark, sf):
    docs, path = D.four_way(spark, sf).select("doc_id", F.col("l0").alias("text")), _folder(spark, "snapshot")
    differing = S.write_snapshot(docs, path).count()
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("written"), F.lit(differing).alias("differing"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def strip_execution_ids(spark, sf):
    nodes = table(spark, sf, "orders").select("o_orderkey", F.struct("o_custkey", F.lit("t").alias("remote_token")).alias("node"), F.lit("b").alias("remote_block_id"))
    return S.strip_execution_ids(nodes).select("o_orderkey", "node.*")


_ABC, _abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(f"{_FOUR} SELECT doc_id, CAST(doc_id * 3 AS VARCHAR) AS revision, sha256(r1) AS raw_hash, sha256(translate(r0, '{_abc}', '{_ABC}')) AS output_hash FROM four")
def pull_receipts(spark, sf):
    pulled = D.four_way(spark, sf)
    return S.pull_receipts(pulled.select("doc_id", (F.col("doc_id") * 3).alias("revision"), F.col("r1").alias("raw"), F.translate("r0", _abc, _ABC).alias("output")))


_VARS = "SELECT CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN 'd' || CAST(s_nationkey AS VARCHAR(9)) ELSE 'd' || CAST(s_nationkey AS VARCHAR(9)) || '/e' || CAST(s_suppkey % 4 AS VARCHAR(9)) END AS dir, 'n' || CAST(s_suppkey % 5 AS VARCHAR(9)) || CASE s_suppkey % 4 WHEN 1 THEN '.x' WHEN 2 THEN '.y' WHEN 3 THEN '.x.z' ELSE '' END AS name, min(s_name) AS value FROM supplier GROUP BY 1, 2"


@query(f"WITH vars AS ({_VARS}), d AS (SELECT c_custkey AS doc_id, 'd' || c_nationkey AS p1, 'd' || c_nationkey || '/e' || c_custkey % 4 AS p2 FROM customer), j AS (SELECT doc_id, name, value, CASE WHEN dir = '' THEN 0 WHEN dir = p1 THEN 1 ELSE 2 END AS depth FROM d JOIN vars ON dir IN ('', p1, p2)) SELECT doc_id, name, value FROM j WHERE NOT EXISTS (SELECT 1 FROM j k WHERE k.doc_id = j.doc_id AND k.depth > j.depth AND (k.name = j.name OR starts_with(j.name, k.name || '.') OR starts_with(k.name, j.name || '.')))")
def layer_variables(spark, sf):
    variables = spark.sql(_VARS.replace("FROM supplier", "FROM {s}"), s=table(spark, sf, "supplier"))
    where = F.concat(F.lit("/d"), F.col("c_nationkey").cast("string"), F.lit("/e"), (F.col("c_custkey") % 4).cast("string"))
    return S.layer_variables(variables, table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), where.alias("dir")))


@query(f"""{D.with_ctes('receipts')}, kept AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 1 THEN l0 END AS sl, CASE WHEN doc_id % 6 = 1 THEN r1 ELSE r0 END AS sr FROM four WHERE doc_id % 8 <> 2),
    b AS (SELECT r.doc_id, version, CASE WHEN sl IS NOT NULL OR (version < 4 AND sha256(l1) = draft_hash) THEN draft_hash END AS local, CASE WHEN CASE WHEN version = 1 THEN sha256(r1) ELSE sha256(sr) END = remote_hash THEN remote_hash END AS remote FROM receipts r JOIN four USING (doc_id) LEFT JOIN kept USING (doc_id)),
    x AS (SELECT *, CASE WHEN local IS NULL THEN CASE WHEN version >= 4 THEN 'draft-base-missing' ELSE 'local-base-missing' END WHEN remote IS NULL THEN CASE WHEN version = 1 THEN 'remote-changed' ELSE 'remote-base-missing' END END AS blocker FROM b)
    SELECT doc_id, version, CASE WHEN blocker IS NULL THEN local END AS local_hash, CASE WHEN blocker IS NULL THEN remote END AS remote_hash, blocker FROM x""")
def load_baselines(spark, sf):
    four = D.four_way(spark, sf)
    kept = four.filter("doc_id % 8 <> 2").selectExpr("doc_id", "CASE WHEN doc_id % 7 <> 1 THEN l0 END AS local", "CASE WHEN doc_id % 6 = 1 THEN r1 ELSE r0 END AS remote")
    out = S.load_baselines(D.receipts(four), kept, four.select("doc_id", F.col("l1").alias("local"), F.col("r1").alias("remote")))
    return out.select("doc_id", "version", F.sha2("local_base", 256).alias("local_hash"), F.sha2("remote_base", 256).alias("remote_hash"), "blocker")


#: By document, what the remote changes: the line after a local edit, the same line otherwise, the same line alike, or a line far from it.
_EDIT = "CASE WHEN m = 0 AND i % 6 = 2 THEN l || ' remote' WHEN m = 1 AND i % 6 = 1 THEN l || ' other' WHEN m = 2 AND i % 6 = 1 THEN l || ' local' WHEN m = 3 AND i % 6 = 4 THEN l || ' remote' ELSE l END"
_LOCAL_EDIT = "CASE WHEN doc_id % 4 = 1 AND i % 6 = 1 THEN l || ' local' ELSE l END"
#: Numbered, so that no two lines of a document are alike and every edit is one line's.
_VERSIONS = f"""{_FOUR}, numbered AS (SELECT doc_id, doc_id % 5 AS m, i, CAST(i AS VARCHAR) || ' ' || l AS l FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS l FROM (SELECT doc_id, string_split(l0, chr(10)) AS a FROM four))),
    edits AS (SELECT doc_id, m, i, l, {_LOCAL_EDIT} AS mine, {_EDIT} AS theirs FROM numbered), n AS (SELECT *, mine <> l AND theirs <> l AND mine <> theirs AS clash FROM edits)"""
_MARKED = "'<<<<<<< LOCAL' || chr(10) || mine || chr(10) || '=======' || chr(10) || theirs || chr(10) || '>>>>>>> REMOTE'"


def _versions(spark, sf):
    lined = D.four_way(spark, sf).select("doc_id", (F.col("doc_id") % 5).alias("m"), F.expr("transform(split(l0, '\\n'), (l, i) -> concat(i, ' ', l))").alias("ls"))
    text = lambda edit: F.expr(f"array_join(transform(ls, (l, i) -> {edit}), '\\n') || '\\n'")
    return lined.select("doc_id", text("l").alias("base"), text(_LOCAL_EDIT).alias("local"), text(_EDIT).alias("remote"))


@query(f"""{_VERSIONS} SELECT doc_id, CASE WHEN bool_and(mine = theirs) THEN 'equal' WHEN bool_and(l = mine) THEN 'remote' WHEN bool_and(l = theirs) THEN 'local' WHEN bool_or(clash) THEN 'conflict' ELSE 'merged' END AS state, CAST(count(*) FILTER (WHERE clash) AS INTEGER) AS conflicts,
    string_agg(CASE WHEN clash THEN {_MARKED} WHEN mine <> l THEN mine ELSE theirs END, chr(10) ORDER BY i) || chr(10) AS merged FROM n GROUP BY doc_id""")
def merge_three_way(spark, sf):
    return M.merge_three_way(_versions(spark, sf))


@query(f"""{_VERSIONS}, r AS (SELECT *, sum(CASE WHEN (mine = theirs) IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, lag(mine = theirs) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM n)),
    g AS (SELECT doc_id, run, bool_and(mine = theirs) AS same, string_agg(mine, chr(10) ORDER BY i) AS mine, string_agg(theirs, chr(10) ORDER BY i) AS theirs FROM r GROUP BY doc_id, run)
    SELECT doc_id, string_agg(CASE WHEN same THEN mine ELSE {_MARKED} END, chr(10) ORDER BY run) || chr(10) AS merged, CASE WHEN bool_and(same) THEN 'equal' ELSE 'conflict' END AS state, CAST(count(*) FILTER (WHERE NOT same) AS INTEGER) AS conflicts FROM g GROUP BY doc_id""")
def merge_two_way(spark, sf):
    return M.merge_two_way(_versions(spark, sf).select("doc_id", "local", "remote"))


@query(f"{_FOUR} SELECT doc_id, hunk, CAST(i AS INTEGER) AS start, CAST(i + 1 AS INTEGER) AS stop, l || ' local' AS lines FROM (SELECT doc_id, i, l, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS hunk FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS l FROM (SELECT doc_id, string_split(l0, chr(10)) AS a FROM four WHERE doc_id % 4 = 1)) WHERE i % 6 = 1)")
def line_changes(spark, sf):
    return M.line_changes(D.four_way(spark, sf).select("doc_id", F.col("l0").alias("base"), F.col("l1").alias("next"))).withColumn("lines", F.array_join("lines", "\n"))


def _landed(spark, sf, cols, name="events"):
    """The table again as a folder that a stream can follow."""
    df = materialize(table(spark, sf, name).select(*cols), "feed")
    return df, spark.readStream.schema(df.schema).parquet(df.inputFiles()[0].rpartition("/")[0])


@query("SELECT token, count(*) AS n FROM (SELECT DISTINCT user_id % 40 || '-' || event_type AS token FROM events) GROUP BY token")
def dedupe_ops_stream(spark, sf):
    _, stream = _landed(spark, sf, [F.concat_ws("-", (F.col("user_id") % 40).cast("string"), "event_type").alias("token"), F.col("ts").cast("timestamp").alias("ts")])
    path = _folder(spark, "ops")
    once = feeds.dedupe_ops_stream(stream, "token", "ts", "36500 days")
    feeds.run_once(once, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"), _folder(spark, "cp"))
    return spark.read.parquet(path).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS doc_id, CAST(max(event_id) AS VARCHAR) AS revision FROM events GROUP BY user_id")
def latest_revision_stream(spark, sf):
    df = materialize(table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").cast("string").alias("revision")).repartition(3), "feed")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(df.inputFiles()[0].rpartition("/")[0])  # several micro-batches
    sink = feeds.LatestRevisions(_folder(spark, "latest"))
    feeds.run_once(stream, sink, _folder(spark, "cp"))
    return sink.read(spark)


@query(f"{_STATUS} SELECT * FROM status")
def drift_stream(spark, sf):
    four = D.four_way(spark, sf)
    df = materialize(four.select("doc_id", F.col("l1").alias("text"), F.col("r1").alias("remote")), "feed")
    stream = spark.readStream.schema(df.schema).parquet(df.inputFiles()[0].rpartition("/")[0])
    path = _folder(spark, "drift")
    feeds.run_once(stream, feeds.DriftFeed(path, materialize(D.receipts(four), "receipts")), _folder(spark, "cp"))
    return spark.read.parquet(path).drop("batch")


@query("SELECT user_id AS doc_id, max(event_id) AS seq, max_by(event_type, event_id) AS checkpoint FROM events GROUP BY user_id")
def journal_stream(spark, sf):
    _, stream = _landed(spark, sf, [F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("checkpoint")])
    journal = feeds.Journal(_folder(spark, "journal"))
    feeds.run_once(stream, journal, _folder(spark, "cp"))
    return journal.read(spark)
