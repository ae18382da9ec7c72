"""Drift of documents against their last synchronisation, and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import canonical_hash


def drift_status(docs: DataFrame, remote: DataFrame, receipts: DataFrame, dialect: str = "plain") -> DataFrame:
    """doc_id, state, local_changed, remote_changed, content_matches, has_receipt.

    ``docs`` and ``remote`` hold doc_id and text. Texts are hashed where they lie: only hashes are joined.
    A local change whose content equals an unchanged remote's is none. Without receipt: untracked.
    """
    a = docs.select("doc_id", F.sha2("text", 256).alias("draft"), canonical_hash(F.col("text")).alias("draft_canonical"))
    b = remote.select("doc_id", F.sha2("text", 256).alias("snapshot"), canonical_hash(F.col("text")).alias("snapshot_canonical"))
    r = receipts.select("doc_id", "draft_hash", "remote_hash", F.col("dialect").alias("receipt_dialect"), F.lit(True).alias("tracked"))
    j = a.join(b, "doc_id").join(r, "doc_id", "left")
    matches = F.col("draft_canonical") == F.col("snapshot_canonical")
    tracked = F.col("tracked").isNotNull()
    local = ~F.col("draft_hash").eqNullSafe(F.col("draft")) | ~F.col("receipt_dialect").eqNullSafe(F.lit(dialect))
    changed = ~F.col("remote_hash").eqNullSafe(F.col("snapshot"))
    local_changed = F.when(~tracked, True).otherwise(local & ~(local & ~changed & matches))
    remote_changed = F.when(~tracked, ~matches).otherwise(changed)
    out = j.select("doc_id", local_changed.alias("local_changed"), remote_changed.alias("remote_changed"), matches.alias("content_matches"), tracked.alias("has_receipt"))
    state = F.when(~F.col("has_receipt"), "untracked").when(F.col("local_changed") & F.col("remote_changed"), "diverged").when(F.col("local_changed"), "local-changed").when(F.col("remote_changed"), "remote-changed").otherwise("clean")
    return out.withColumn("state", state)


def recommend(status: DataFrame, blocked: Column | None = None) -> DataFrame:
    """``action`` for each document and the ``reason``; the first rule that fits."""
    state = F.col("state")
    rules = [
        (F.lit(False) if blocked is None else blocked, "fix-source", "the source has blockers"),
        (state == "clean", "no-action", "nothing changed"),
        (F.col("content_matches") & F.col("has_receipt"), "publish-dry-run", "contents are equal, the receipt is old"),
        (F.col("content_matches"), "publish-dry-run", "contents are equal, there is no receipt"),
        (state == "local-changed", "publish-dry-run", "only the local text changed"),
        (state == "remote-changed", "pull-review", "only the remote text changed"),
        (state == "diverged", "resolve-divergence", "both texts changed"),
    ]
    choice = F.struct(F.lit("adopt-or-replace").alias("action"), F.lit("texts differ and there is no receipt").alias("reason"))
    for fits, action, reason in reversed(rules):
        choice = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))).otherwise(choice)
    return status.withColumn("choice", choice).select(*status.columns, "choice.action", "choice.reason")


def publish_decision(status: DataFrame, plans: DataFrame) -> DataFrame:
    """doc_id, decision, risks. ``plans`` has doc_id, n_ops, n_blockers and may have ``create``. A blocker stops the whole document.

    A document of a plan that the remote side lacks, or that is to be created, is created; nothing is at risk then.
    """
    j = status.withColumn("known", F.lit(True)).join(plans, "doc_id", "full_outer")
    ops, blockers = F.coalesce("n_ops", F.lit(0)), F.coalesce("n_blockers", F.lit(0))
    create = F.col("known").isNull() | (F.coalesce("create", F.lit(False)) if "create" in plans.columns else F.lit(False))
    decision = F.when(blockers > 0, "blocked").when(create, "create").when(F.col("state") == "clean", "no-op").when(~F.col("has_receipt") & F.col("content_matches"), "adopt").when(ops > 0, "patch").otherwise("replace")
    risks = F.array_compact(F.array(F.when(F.col("remote_changed"), "remote-changed"), F.when(~F.col("has_receipt"), "untracked"), F.when(decision == "replace", "rewrites-everything")))
    return j.select("doc_id", decision.alias("decision"), F.when(decision == "create", "").otherwise(F.array_join(risks, ",")).alias("risks"))


def select_base(docs: DataFrame, explicit: DataFrame, snapshots: DataFrame, receipts: DataFrame) -> DataFrame:
    """Merge base of each document and where it came from: given, receipt snapshot, unchanged local text, none."""
    e = explicit.select("doc_id", F.col("text").alias("given"))
    s = snapshots.select("doc_id", F.col("text").alias("snap"))
    r = receipts.select("doc_id", "draft_hash")
    j = docs.join(e, "doc_id", "left").join(s, "doc_id", "left").join(r, "doc_id", "left")
    unchanged = F.when(F.sha2("text", 256) == F.col("draft_hash"), F.col("text"))
    snap = F.when(F.col("draft_hash").isNotNull(), F.col("snap"))
    source = F.when(F.col("given").isNotNull(), "explicit").when(snap.isNotNull(), "receipt").when(unchanged.isNotNull(), "local").otherwise("none")
    return j.select("doc_id", F.coalesce("given", snap, unchanged).alias("base"), source.alias("source"))
