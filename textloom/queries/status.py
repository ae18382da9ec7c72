"""Drift, recommendation, decision, merge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import status as S
from textloom.queries import query
from textloom.sources import derived as D

_CANON = "regexp_replace(regexp_replace(regexp_replace({c}, '(?m)[ \\t]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_STATUS = f"""{D.with_ctes('receipts')}, h AS (SELECT doc_id, sha256(l1) AS draft, sha256(r1) AS snap, sha256({_CANON.format(c='l1')}) = sha256({_CANON.format(c='r1')}) AS content_matches FROM four),
    c AS (SELECT h.doc_id, content_matches, r.doc_id IS NOT NULL AS has_receipt, draft <> draft_hash OR dialect <> 'plain' AS l, snap <> remote_hash AS r FROM h LEFT JOIN receipts r ON r.doc_id = h.doc_id),
    d AS (SELECT doc_id, content_matches, has_receipt, CASE WHEN NOT has_receipt THEN true ELSE l AND NOT (NOT r AND content_matches) END AS local_changed, CASE WHEN NOT has_receipt THEN NOT content_matches ELSE r END AS remote_changed FROM c),
    status AS (SELECT *, CASE WHEN NOT has_receipt THEN 'untracked' WHEN local_changed AND remote_changed THEN 'diverged' WHEN local_changed THEN 'local-changed' WHEN remote_changed THEN 'remote-changed' ELSE 'clean' END AS state FROM d)"""


def _status(spark, sf):
    four = D.four_way(spark, sf)
    return S.drift_status(four.select("doc_id", F.col("l1").alias("text")), four.select("doc_id", F.col("r1").alias("text")), D.receipts(four))


@query(f"{_STATUS} SELECT * FROM status")
def drift_status(spark, sf):
    return _status(spark, sf)


@query(f"""{_STATUS} SELECT doc_id, state, CASE WHEN doc_id % 17 = 0 THEN 'fix-source' WHEN state = 'clean' THEN 'no-action' WHEN content_matches OR state = 'local-changed' THEN 'publish-dry-run' WHEN state = 'remote-changed' THEN 'pull-review' WHEN state = 'diverged' THEN 'resolve-divergence' ELSE 'adopt-or-replace' END AS action,
    CASE WHEN doc_id % 17 = 0 THEN 'the source has blockers' WHEN state = 'clean' THEN 'nothing changed' WHEN content_matches AND has_receipt THEN 'contents are equal, the receipt is old' WHEN content_matches THEN 'contents are equal, there is no receipt' WHEN state = 'local-changed' THEN 'only the local text changed'
    WHEN state = 'remote-changed' THEN 'only the remote text changed' WHEN state = 'diverged' THEN 'both texts changed' ELSE 'texts differ and there is no receipt' END AS reason FROM status""")
def recommend(spark, sf):
    return S.recommend(_status(spark, sf), F.col("doc_id") % 17 == 0).select("doc_id", "state", "action", "reason")


@query(f"""{_STATUS}, p AS (SELECT *, CASE WHEN doc_id % 13 = 1 THEN 2 ELSE 0 END AS n_blockers, CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 0 END AS n_ops, doc_id % 10 = 0 AS new FROM status), x AS (SELECT *, CASE WHEN n_blockers > 0 THEN 'blocked' WHEN new THEN 'create' WHEN state = 'clean' THEN 'no-op' WHEN NOT has_receipt AND content_matches THEN 'adopt' WHEN n_ops > 0 THEN 'patch' ELSE 'replace' END AS decision FROM p)
    SELECT doc_id, decision, CASE WHEN decision = 'create' OR new THEN '' ELSE concat_ws(',', CASE WHEN remote_changed THEN 'remote-changed' END, CASE WHEN NOT has_receipt THEN 'untracked' END, CASE WHEN decision = 'replace' THEN 'rewrites-everything' END) END AS risks FROM x""")
def publish_decision(spark, sf):
    status = _status(spark, sf)
    plans = status.select("doc_id", F.when(F.col("doc_id") % 13 == 1, 2).otherwise(0).alias("n_blockers"), F.when(F.col("doc_id") % 3 == 0, 4).otherwise(0).alias("n_ops"))
    # the remote side lacks every tenth document
    return S.publish_decision(status.filter("doc_id % 10 <> 0"), plans)


@query(f"""{D.with_ctes('receipts')}, j AS (SELECT four.doc_id, l0, l1, r.doc_id AS tracked, draft_hash, CASE WHEN four.doc_id % 6 = 5 THEN r0 END AS given, CASE WHEN four.doc_id % 4 = 3 THEN l0 END AS snap FROM four LEFT JOIN receipts r ON r.doc_id = four.doc_id),
    s AS (SELECT doc_id, given, CASE WHEN tracked IS NOT NULL THEN snap END AS snap, CASE WHEN sha256(l1) = draft_hash THEN l1 END AS own FROM j)
    SELECT doc_id, sha256(coalesce(given, snap, own)) AS base_hash, CASE WHEN given IS NOT NULL THEN 'explicit' WHEN snap IS NOT NULL THEN 'receipt' WHEN own IS NOT NULL THEN 'local' ELSE 'none' END AS source FROM s""")
def select_base(spark, sf):
    four = D.four_way(spark, sf)
    text = lambda c, cond="true": four.filter(cond).select("doc_id", F.col(c).alias("text"))
    out = S.select_base(text("l1"), text("r0", "doc_id % 6 = 5"), text("l0", "doc_id % 4 = 3"), D.receipts(four))
    return out.select("doc_id", F.sha2("base", 256).alias("base_hash"), "source")
