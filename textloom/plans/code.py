"""Plans for code nodes of tracked documents: four versions to updates, moves, creations, deletions, rebuilt sections and blockers.

Nodes are rows of (doc_id, pos, section, kind, locator, value, language, caption, issue) of all kinds, of which ``code`` is planned;
the others tell where code stands. A node is the base node of its content and language where only one is left, else of its locator
(``match_in_order``). Content and language merge field by field. A place is the section and the node before, known by content if it is code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.ranges import numbered, running
from textloom.plans.match import match_in_order
from textloom.runtime import materialize

_FIELDS = ("locator", "section", "value", "language", "caption", "print", "place", "after")


def placed_code(nodes: DataFrame) -> DataFrame:
    """Code nodes with ``print`` (of content and language), ``after`` (the node before) and ``place``."""
    own = F.sha2(F.to_json(F.struct(F.col("value").alias("content"), F.coalesce("language", F.lit("")).alias("language"))), 256)
    shown = F.when(F.col("kind") == "code", F.concat(F.lit("code:"), own)).otherwise(F.concat_ws(":", "kind", "locator"))
    held = running(nodes.withColumn("print", own).withColumn("shown", shown), ["doc_id"], ["pos", "locator"], lasts={"before": F.col("shown"), "after": F.col("locator")})
    return held.filter("kind = 'code'").withColumn("place", F.concat(F.coalesce("section", F.lit("")), F.lit("|"), F.coalesce("before", F.lit("<start>")))).drop("shown", "before")


def _side(code: DataFrame, name: str) -> DataFrame:
    return code.select("doc_id", *(F.col(c).alias(f"{name}_{c}") for c in _FIELDS))


def _correspondence(lb: DataFrame, lc: DataFrame, rb: DataFrame, rc: DataFrame) -> DataFrame:
    """One row per base node: its four versions, as far as there are any. A local base node is the remote base node at its locator, else of its number."""
    rules = [("content", ["print"], True), ("locator", ["locator"], False)]
    to_local, to_remote = (materialize(match_in_order(b, c, rules), "code-pairs") for b, c in ((lb, lc), (rb, rc)))
    nth = lambda df: numbered(df, ["doc_id"], ["pos", "locator"], "nth")
    rn = nth(rb).select("doc_id", F.col("nth"), F.col("locator").alias("nth_locator"))
    known = rb.select("doc_id", "locator", F.col("locator").alias("same_locator"))
    rows = nth(lb).join(known, ["doc_id", "locator"], "left").join(rn, ["doc_id", "nth"], "left").withColumn("rb", F.coalesce("same_locator", "nth_locator"))
    rows = _side(rows, "lb").join(rows.select("doc_id", F.col("locator").alias("lb_locator"), "rb"), ["doc_id", "lb_locator"])
    pair = lambda pairs, a, b: pairs.select("doc_id", F.col("base_id").alias(a), F.col("current_id").alias(b))
    rows = rows.join(pair(to_local, "lb_locator", "lc_locator"), ["doc_id", "lb_locator"], "left").join(_side(lc, "lc"), ["doc_id", "lc_locator"], "left")
    rows = rows.join(_side(rb, "rb").withColumn("rb", F.col("rb_locator")), ["doc_id", "rb"], "left")
    return rows.join(pair(to_remote, "rb", "rc_locator"), ["doc_id", "rb"], "left").join(_side(rc, "rc"), ["doc_id", "rc_locator"], "left")


def _sections_changed(base: DataFrame, current: DataFrame) -> DataFrame:
    """(doc_id, section) whose code isn't the same, one by one, in both."""
    parts = [numbered(df, ["doc_id", "section"], ["pos", "locator"], "nth").select("doc_id", "section", "nth", F.struct("print", "place").alias(n)) for df, n in ((base, "a"), (current, "b"))]
    return parts[0].join(parts[1], ["doc_id", "section", "nth"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id", "section").distinct()


def _rows(df: DataFrame, locator: Column, section: Column, op: Column | None = None, blocker: Column | None = None, field: Column | None = None, **more: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    given = {"op": op, "blocker": blocker, "field": field, **more}
    return df.select("doc_id", locator.alias("locator"), section.alias("section"), *((given.get(c) if given.get(c) is not None else none).alias(c) for c in ("op", "target", "after", "content", "language", "blocker", "field")))


def code_plan(l0: DataFrame, l1: DataFrame, r0: DataFrame, r1: DataFrame) -> DataFrame:
    """(doc_id, locator, section, op, target, after, content, language, blocker, field).

    Ops: update, move (behind ``after``), create, delete, and for a section whose code corresponds to nothing on both sides, reconcile. Blockers:
    issue (a node that can't be written; then the document has no ops), remote-code-conflict (field content, language, position or deletion),
    code-correspondence-ambiguous (no remote base), remote-code-scope-changed and caption-correspondence-ambiguous (sections that can't be rebuilt).
    """
    lb, lc, rb, rc = (materialize(placed_code(df), "code-nodes") for df in (l0, l1, r0, r1))
    rows = materialize(_correspondence(lb, lc, rb, rc), "code-four")
    has = {n: F.col(f"{n}_locator").isNotNull() for n in ("lc", "rb", "rc")}
    equal = lambda a, b: F.col(f"{a}_print") == F.col(f"{b}_print")
    same_place = lambda a, b: F.col(f"{a}_place") == F.col(f"{b}_place")
    whole = lambda a, b: equal(a, b) & same_place(a, b)
    changed = lambda c, a, b: ~F.col(f"{a}_{c}").eqNullSafe(F.col(f"{b}_{c}"))
    differs = {c: changed(c, "lb", "lc") & changed(c, "rb", "rc") & changed(c, "lc", "rc") for c in ("value", "language")}
    merged = {c: F.when(changed(c, "lb", "lc"), F.col(f"lc_{c}")).otherwise(F.col(f"rc_{c}")) for c in ("value", "language")}
    moved, remote_moved = ~same_place("lb", "lc"), ~same_place("rb", "rc")
    all_there = rows.filter(has["rb"] & has["lc"] & has["rc"])
    calm = all_there.filter(~(differs["value"] | differs["language"]))
    astray = moved & remote_moved & ~same_place("lc", "rc")
    settled = calm.filter(~astray)
    lb_at, lc_at = (F.col("lb_locator"), F.col("lb_section")), (F.col("lc_locator"), F.col("lc_section"))
    conflict, text = F.lit("remote-code-conflict"), lambda s: F.lit(s)
    gone = rows.filter(has["rb"] & ~has["lc"] & has["rc"])
    content = {"content": merged["value"], "language": merged["language"], "target": F.col("rc_locator")}
    parts = [
        _rows(rows.filter(~has["rb"] & ~F.coalesce(whole("lb", "lc"), F.lit(False))), *lb_at, blocker=text("code-correspondence-ambiguous")),
        _rows(gone.filter(~whole("rb", "rc")), *lb_at, blocker=conflict, field=text("deletion")),
        _rows(gone.filter(whole("rb", "rc")), *lb_at, op=text("delete"), target=F.col("rc_locator")),
        _rows(rows.filter(has["rb"] & has["lc"] & ~has["rc"]), *lc_at, blocker=conflict, field=text("deletion")),
        _rows(all_there.filter(differs["value"]), *lc_at, blocker=conflict, field=text("content")),
        _rows(all_there.filter(differs["language"]), *lc_at, blocker=conflict, field=text("language")),
        _rows(calm.filter(astray), *lc_at, blocker=conflict, field=text("position")),
        _rows(settled.filter(~merged["value"].eqNullSafe(F.col("rc_value")) | ~merged["language"].eqNullSafe(F.col("rc_language"))), *lc_at, op=text("update"), **content),
        _rows(settled.filter(moved & ~remote_moved), *lc_at, op=text("move"), after=F.col("lc_after"), **content),
    ]
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    tracked = materialize(union(parts), "code-ops")

    dropped = rows.filter(~has["lc"])
    fresh = materialize(lc.join(rows.filter(has["lc"]).select("doc_id", F.col("lc_locator").alias("locator")), ["doc_id", "locator"], "left_anti"), "fresh-code")
    both = fresh.select("doc_id").distinct().join(dropped.select("doc_id").distinct(), "doc_id")
    first = fresh.join(both, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("locator", "section"), F.struct("pos", "locator")).alias("first"))
    sections = dropped.select("doc_id", F.col("lb_section").alias("section")).unionByName(fresh.select("doc_id", "section")).join(both, "doc_id").distinct()
    shaken = sections.join(_sections_changed(rb, rc), ["doc_id", "section"]).select("doc_id").distinct().withColumn("why", F.lit("remote-code-scope-changed"))
    captioned = dropped.filter(has["rc"] & (F.coalesce("rc_caption", F.lit("")) != "")).groupBy("doc_id").agg(F.min("rc_locator").alias("captioned"))
    state = materialize(first.join(shaken, "doc_id", "left").join(captioned, "doc_id", "left").withColumn("why", F.coalesce("why", F.when(F.col("captioned").isNotNull(), "caption-correspondence-ambiguous"))), "code-reconcile")
    rebuilt = sections.join(state.filter("why IS NULL").select("doc_id"), "doc_id", "left_semi")
    creates = fresh.join(both, "doc_id", "left_anti")
    plan = union([
        tracked.join(rebuilt.withColumn("rebuilt", F.lit(True)), ["doc_id", "section"], "left").filter("op IS NULL OR rebuilt IS NULL").drop("rebuilt").select(*tracked.columns),
        _rows(creates, F.col("locator"), F.col("section"), op=text("create"), after=F.col("after"), content=F.col("value"), language=F.col("language")),
        _rows(rebuilt.withColumn("locator", F.lit(None).cast("string")), F.col("locator"), F.col("section"), op=text("reconcile")),
        _rows(state.filter("why IS NOT NULL"), F.when(F.col("why") == "remote-code-scope-changed", F.col("first.locator")).otherwise(F.col("captioned")), F.lit(None).cast("string"), blocker=F.col("why")),
    ])
    broken = lc.filter("issue IS NOT NULL").unionByName(rc.filter("issue IS NOT NULL"))
    issues = _rows(broken, F.col("locator"), F.col("section"), blocker=F.concat(text("issue:"), F.col("issue")))
    return plan.join(broken.select("doc_id").distinct(), "doc_id", "left_anti").select(*tracked.columns).unionByName(issues)
