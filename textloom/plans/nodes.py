"""Plans over document nodes: alignment, three-way operations, reports.

Nodes are rows of doc_id, pos, section, kind, locator and value. A plan never guesses: what is ambiguous or
changed on both sides becomes a blocker row, and a blocker anywhere in a document empties its plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.lines import fold
from textloom.operators.ranges import numbered, running
from textloom.runtime import materialize

KEY = ["doc_id", "locator"]


def align(base: DataFrame, current: DataFrame, group: list[str], passes: list[tuple[str, list[str], bool]], id_col: str) -> DataFrame:
    """(group, base_id, current_id, how) in passes of (name, keys, unique), each on what the earlier left.

    A unique pass takes keys that occur once on both sides; the others need keys that are unique by nature.
    """
    rest_a, rest_b = base.withColumn("base_id", F.col(id_col)), current.withColumn("current_id", F.col(id_col))
    found = None
    for name, keys, unique in passes:
        on = [*group, *keys]
        a, b = (df.join(df.groupBy(*on).count().filter("count = 1").drop("count"), on) if unique else df for df in (rest_a, rest_b))
        new = a.select(*on, "base_id").join(b.select(*on, "current_id"), on).select(*group, "base_id", "current_id", F.lit(name).alias("how"))
        new = materialize(new, "aligned")  # later passes read it twice
        found = new if found is None else found.unionByName(new)
        rest_a = rest_a.join(new.select(*group, "base_id"), [*group, "base_id"], "left_anti")
        rest_b = rest_b.join(new.select(*group, "current_id"), [*group, "current_id"], "left_anti")
    return found


def callout_passes(base: DataFrame, current: DataFrame) -> DataFrame:
    """Pairs of callouts (doc_id, base_id, current_id, how), ``kind`` being their type: same content in the section, same place and type,
    the only one of its type left in the section, same place."""
    passes = [("content", ["section", "kind", "value"], True), ("place", ["locator", "kind"], False), ("section", ["section", "kind"], True), ("locator", ["locator"], False)]
    return align(base, current, ["doc_id"], passes, "locator")


def single_leftover(base: DataFrame, current: DataFrame, pairs: DataFrame, group: list[str], id_col: str) -> DataFrame:
    """The pair of each group that has exactly one row left on both sides."""
    one = lambda df, side: df.withColumn(side, F.col(id_col)).join(pairs.select(*group, side), [*group, side], "left_anti").groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min(side).alias(side)).filter("n = 1").drop("n")
    return one(base, "base_id").join(one(current, "current_id"), group).select(*group, "base_id", "current_id", F.lit("leftover").alias("how"))


def identified(base: DataFrame, current: DataFrame) -> DataFrame:
    """``current`` with the locator of the base node that each node is, or ``new|`` and its own.

    Ordinals shift with every insertion, so a node is known by its value where that is unique in its section,
    then in the document. What is left is known by its place: between the same known neighbours, where both
    sides have equally many left, the nth of one kind is the nth.
    """
    pairs = align(base, current, ["doc_id"], [("section", ["section", "value"], True), ("document", ["value"], True)], "locator")

    def left(df: DataFrame, own: str) -> DataFrame:
        known = pairs.select("doc_id", F.col(own).alias("locator"), F.col("base_id").alias("known"))
        w = Window.partitionBy("doc_id").orderBy("pos")
        rows = df.join(known, KEY, "left").select(
            *KEY, "pos", "kind", "known", F.coalesce(F.last("known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit("")).alias("after"),
            F.coalesce(F.first("known", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit("")).alias("before"),
        ).filter("known IS NULL")
        gap = Window.partitionBy("doc_id", "after", "before")
        return rows.select("doc_id", F.col("locator").alias(own), "kind", "after", "before", F.row_number().over(gap.orderBy("pos")).alias("nth"), F.count(F.lit(1)).over(gap).alias("n"))

    placed = left(base, "base_id").join(left(current, "current_id"), ["doc_id", "after", "before", "nth", "n", "kind"])
    every = pairs.select("doc_id", F.col("current_id").alias("locator"), "base_id").unionByName(placed.select("doc_id", F.col("current_id").alias("locator"), "base_id"))
    j = current.join(every, KEY, "left")
    return j.select(*(F.coalesce("base_id", F.concat(F.lit("new|"), "locator")).alias(c) if c == "locator" else F.col(c) for c in current.columns))


def _four(l0: DataFrame, l1: DataFrame, r0: DataFrame, r1: DataFrame) -> DataFrame:
    """Values of four versions by node; the bases are the same nodes by locator, the later versions by correspondence."""
    parts = [df.select(*KEY, F.col("value").alias(n), F.lit(True).alias(f"in_{n}")) for df, n in ((l0, "l0"), (identified(l0, l1), "l1"), (r0, "r0"), (identified(r0, r1), "r1"))]
    return reduce(lambda a, b: a.join(b, KEY, "full_outer"), parts)


def _has(n: str) -> Column:
    return F.col(f"in_{n}").isNotNull()


def unclear_documents(l0: DataFrame, l1: DataFrame, r0: DataFrame, r1: DataFrame) -> DataFrame:
    """(doc_id, blocker) of documents whose nodes can't be told apart or don't keep their order.

    ambiguous-repeats: a side has more or fewer nodes than its base, which has some text several times that the side still has.
    order-changed: nodes other than code that both sides have stand in another order.
    """
    def repeats(base: DataFrame, now: DataFrame) -> DataFrame:
        sizes = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("was")).join(now.groupBy("doc_id").agg(F.count(F.lit(1)).alias("is")), "doc_id").filter("was <> is").select("doc_id")
        several = base.filter("kind = 'text'").groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return several.join(now.filter("kind = 'text'").select("doc_id", "value").distinct(), ["doc_id", "value"], "left_semi").join(sizes, "doc_id", "left_semi").select("doc_id").distinct()

    places = [identified(b, n).filter("kind <> 'code' AND NOT startswith(locator, 'new|')").select(*KEY, F.col("pos").alias(p)) for b, n, p in ((l0, l1, "here"), (r0, r1, "there"))]
    shared = running(places[0].join(places[1], KEY), ["doc_id"], ["here", "locator"], lasts={"before": F.col("there")})
    turned = shared.filter("before >= there").select("doc_id").distinct()
    unclear = repeats(l0, l1).unionByName(repeats(r0, r1)).distinct().withColumn("blocker", F.lit("ambiguous-repeats"))
    return materialize(unclear.unionByName(turned.join(unclear, "doc_id", "left_anti").withColumn("blocker", F.lit("order-changed"))), "unclear")


def text_plan(l0: DataFrame, l1: DataFrame, r0: DataFrame, r1: DataFrame) -> DataFrame:
    """Local changes carried to the remote: (doc_id, locator, op, blocker). A change the remote already has is no op.

    A document with unclear nodes (``unclear_documents``) has that blocker as its one row, without a locator, and no ops.
    """
    j = _four(l0, l1, r0, r1)
    remote_same = F.col("r0").eqNullSafe(F.col("r1")) & (_has("r0") == _has("r1"))
    added, removed = ~_has("l0") & _has("l1"), _has("l0") & ~_has("l1")
    updated = _has("l0") & _has("l1") & (F.col("l0") != F.col("l1"))
    op = (
        F.when(added & ~_has("r1"), "create").when(removed & _has("r1") & remote_same, "delete").when(updated & _has("r1") & remote_same, "update")
    )
    blocker = (
        F.when(added & _has("r1") & (F.col("r1") != F.col("l1")), "taken").when(removed & _has("r1") & ~remote_same, "changed-remotely")
        .when(updated & ~_has("r1"), "missing-remotely").when(updated & ~remote_same & (F.col("r1") != F.col("l1")), "changed-remotely")
    )
    unclear = unclear_documents(l0, l1, r0, r1)
    found = j.select(*KEY, op.alias("op"), blocker.alias("blocker")).filter("op IS NOT NULL OR blocker IS NOT NULL").join(unclear.select("doc_id"), "doc_id", "left_anti")
    none = F.lit(None).cast("string")
    return found.unionByName(unclear.select("doc_id", none.alias("locator"), none.alias("op"), "blocker"))


def desired_text(l0: DataFrame, l1: DataFrame, r0: DataFrame, r1: DataFrame) -> DataFrame:
    """Text that each node of the local document should have remotely: the remote's while locally unchanged; conflict if both changed."""
    j = _four(l0, l1, r0, r1).filter(_has("l1"))
    local, remote = ~F.col("l0").eqNullSafe(F.col("l1")), ~F.col("r0").eqNullSafe(F.col("r1"))
    conflict = local & remote & ~F.col("l1").eqNullSafe(F.col("r1"))
    return j.select(*KEY, F.when(local, F.col("l1")).otherwise(F.coalesce("r1", "l1")).alias("text"), conflict.alias("conflict"))


def scoped_plan(plans: list[tuple[str, DataFrame]]) -> DataFrame:
    """Per document over all plans: ops and blockers; any blocker leaves no ops."""
    every = reduce(lambda a, b: a.unionByName(b), (p.select("doc_id", "op", "blocker", F.lit(n).alias("plan")) for n, p in plans))
    s = every.groupBy("doc_id").agg(F.count("op").alias("ops"), F.count("blocker").alias("blockers"), F.array_join(F.array_sort(F.collect_set("plan")), ",").alias("plans"))
    return s.select("doc_id", F.when(F.col("blockers") > 0, F.lit(0).cast("long")).otherwise(F.col("ops")).alias("ops"), "blockers", "plans")


def change_summary(plan: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ops by document and section, with the locators in order."""
    j = plan.filter("op IS NOT NULL").join(nodes.select(*KEY, "section").distinct(), KEY, "left")
    return j.groupBy("doc_id", F.coalesce("section", F.lit("")).alias("section")).agg(*(F.count_if(F.col("op") == o).alias(o) for o in ("create", "update", "delete")), F.array_join(F.array_sort(F.collect_list("locator")), ",").alias("locators"))


def round_trip_report(diagnostics: DataFrame) -> DataFrame:
    """Per document: distinct findings and whether it is safe to publish (no blocker among them)."""
    d = diagnostics.select("doc_id", "code", "severity").distinct()
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("findings"), F.bool_and(F.col("severity") != "blocker").alias("safe_to_publish"))


def dedupe_diagnostics(diagnostics: DataFrame, keys: list[str]) -> DataFrame:
    return diagnostics.select(*keys).distinct()


def identity_counts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("ambiguous", F.col("n") > 1)


def resource_plan(local: DataFrame, remote: DataFrame, receipts: DataFrame, key: list[str]) -> DataFrame:
    """Protected resources by identity: adopt, protect, changed, missing, ambiguous, removed.

    ``local`` and ``remote`` are (key, value), ``receipts`` (key, hash of the value last seen).
    """
    counted = lambda df, n: df.groupBy(*key).agg(F.count(F.lit(1)).alias(f"{n}_n"), F.min("value").alias(f"{n}_value"))
    j = counted(local, "l").join(counted(remote, "r"), key, "full_outer").join(receipts.select(*key, F.col("hash").alias("seen")), key, "full_outer")
    tracked = F.col("seen").isNotNull()
    state = (
        F.when(F.col("l_n").isNull() & tracked, "removed").when(F.col("l_n").isNull(), None).when((F.col("l_n") > 1) | (F.coalesce("r_n", F.lit(0)) > 1), "ambiguous").when(F.col("r_n").isNull(), "missing")
        .when(~tracked, "adopt").when(F.sha2("r_value", 256) == F.col("seen"), "protect").otherwise("changed")
    )
    return j.select(*key, state.alias("state")).filter("state IS NOT NULL")


def asset_plan(local: DataFrame, remote: DataFrame, receipts: DataFrame, confirmed: list[str]) -> DataFrame:
    """Assets (asset, hash) in six states, and what to do: create, adopt, update, overwrite, protect, none.

    A remote change is only overwritten where the asset is confirmed.
    """
    j = local.select("asset", F.col("hash").alias("now")).join(remote.select("asset", F.col("hash").alias("there")), "asset", "full_outer").join(receipts.select("asset", "local_hash", "remote_hash"), "asset", "left")
    tracked = F.col("local_hash").isNotNull()
    lc, rc = F.col("now") != F.col("local_hash"), F.col("there") != F.col("remote_hash")
    state = (
        F.when(F.col("now").isNull(), F.when(tracked, "missing")).when(~tracked, "untracked").when(F.col("there").isNull(), "missing")
        .when(lc & rc, "conflict").when(lc, "local-changed").when(rc, "remote-changed").otherwise("clean")
    )
    may = F.col("asset").isin(confirmed) if confirmed else F.lit(False)
    action = (
        F.when(F.col("now").isNull(), "none").when((F.col("state") == "untracked") & F.col("there").isNull(), "create").when(F.col("state") == "untracked", "adopt").when(F.col("state") == "missing", "create")
        .when(F.col("state") == "local-changed", "update").when(F.col("state").isin("conflict", "remote-changed"), F.when(may, "overwrite").otherwise("protect")).otherwise("none")
    )
    return j.withColumn("state", state).filter("state IS NOT NULL").select("asset", "state", action.alias("action"))


def token_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Boundary tokens by (doc_id, section, value): create, delete, move (another predecessor) or blocked if not unique."""
    def placed(df: DataFrame, n: str) -> DataFrame:
        w = Window.partitionBy("doc_id").orderBy("pos")
        before = F.last(F.when(F.col("kind") != "code", F.col("value")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        t = df.withColumn("before", before).filter("kind = 'code'")
        return t.groupBy("doc_id", "section", "value").agg(F.count(F.lit(1)).alias(f"{n}_n"), F.min("before").alias(f"{n}_before"), F.lit(True).alias(f"in_{n}"))

    j = placed(local, "l").join(placed(remote, "r"), ["doc_id", "section", "value"], "full_outer")
    twice = (F.coalesce("l_n", F.lit(0)) > 1) | (F.coalesce("r_n", F.lit(0)) > 1)
    op = F.when(twice, "blocked").when(~_has("r"), "create").when(~_has("l"), "delete").when(~F.col("l_before").eqNullSafe(F.col("r_before")), "move")
    return j.select("doc_id", "section", "value", op.alias("op")).filter("op IS NOT NULL")


def loss_report(l0: DataFrame, l1: DataFrame, r0: DataFrame, r1: DataFrame) -> DataFrame:
    """What the two bases disagree on: local-only, remote-only, divergent; repairable while the later versions left it alone."""
    j = _four(l0, l1, r0, r1)
    kind = F.when(_has("l0") & ~_has("r0"), "local-only").when(~_has("l0") & _has("r0"), "remote-only").when(F.col("l0") != F.col("r0"), "divergent")
    stable = (F.col("l0").eqNullSafe(F.col("l1"))) & (F.col("r0").eqNullSafe(F.col("r1")))
    return j.select(*KEY, kind.alias("kind"), F.when(stable, "repairable").otherwise("blocked").alias("state")).filter("kind IS NOT NULL")


def adoption_report(l0: DataFrame, l1: DataFrame, r0: DataFrame) -> DataFrame:
    """Per document: counts of equal and unequal nodes, whether adopting is safe, and a fingerprint of what was reviewed."""
    a, b, c = (df.select(*KEY, F.col("value").alias(n)) for df, n in ((l0, "l0"), (identified(l0, l1), "l1"), (r0, "r0")))
    j = a.join(b, KEY, "full_outer").join(c, KEY, "full_outer")
    line = F.concat_ws("|", "locator", *(F.coalesce(x, F.lit("-")) for x in ("l0", "l1", "r0")))
    return j.groupBy("doc_id").agg(
        F.count_if(F.col("l0").eqNullSafe(F.col("r0"))).alias("matching"), F.count_if(~F.col("l0").eqNullSafe(F.col("r0"))).alias("divergent"), F.count_if(~F.col("l0").eqNullSafe(F.col("l1"))).alias("pending"),
        F.bool_and(F.col("l0").eqNullSafe(F.col("r0"))).alias("safe"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"),
    )


def scope_audit(before: DataFrame, after: DataFrame, scopes: DataFrame) -> DataFrame:
    """Nodes outside the verified sections that changed: (doc_id, section, ordinal, change). Ordinals are counted anew on both sides."""
    def numbered(df: DataFrame, n: str) -> DataFrame:
        kept = df.join(scopes.select("doc_id", "section").distinct(), ["doc_id", "section"], "left_anti")
        return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("pos"))).select("doc_id", "section", "ordinal", F.col("value").alias(n))

    j = numbered(before, "was").join(numbered(after, "now"), ["doc_id", "section", "ordinal"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "updated")
    return j.select("doc_id", "section", "ordinal", change.alias("change")).filter("change IS NOT NULL")


def block_patch(remote: DataFrame, desired: DataFrame) -> DataFrame:
    """Ops between sequences (doc_id, pos, value) after the common prefix and suffix: (doc_id, op, at, value).

    What is left is cut at values unique on both sides that keep their order; in each gap rows meet by
    number: both there is an update, the remote's alone a delete, the desired's alone a create.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    a, b = (df.select("doc_id", "value", (F.row_number().over(w) - 1).alias("at")) for df in (remote, desired))
    once = lambda df, n: df.join(df.groupBy("doc_id", "value").count().filter("count = 1").select("doc_id", "value"), ["doc_id", "value"]).withColumnRenamed("at", n)
    anchors = once(a, "ra").join(once(b, "rb"), ["doc_id", "value"]).select("doc_id", "ra", "rb")
    # an anchor stands if no anchor before it in the remote lies at or after it in the desired text, nor one after it before it
    up = Window.partitionBy("doc_id").orderBy("ra")
    highest, lowest = F.max("rb").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.min("rb").over(up.rowsBetween(1, Window.unboundedFollowing))
    anchors = anchors.withColumn("hi", highest).withColumn("lo", lowest).filter("(hi IS NULL OR hi < rb) AND (lo IS NULL OR lo > rb)").select("doc_id", "ra", "rb")

    def gaps(df: DataFrame, n: str) -> DataFrame:
        marked = df.join(anchors.select("doc_id", F.col(n).alias("at"), F.lit(1).alias("anchor")), ["doc_id", "at"], "left")
        order = Window.partitionBy("doc_id").orderBy("at")
        numbered = marked.withColumn("gap", F.sum(F.coalesce("anchor", F.lit(0))).over(order)).filter("anchor IS NULL")
        return numbered.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "gap").orderBy("at"))).select("doc_id", "gap", "nth", F.col("at").alias(n), F.col("value").alias(f"v_{n}"))

    j = gaps(a, "ra").join(gaps(b, "rb"), ["doc_id", "gap", "nth"], "full_outer")
    op = F.when(F.col("ra").isNull(), "create").when(F.col("rb").isNull(), "delete").when(F.col("v_ra") != F.col("v_rb"), "update")
    return j.select("doc_id", op.alias("op"), F.coalesce("ra", "rb").alias("at"), F.coalesce("v_rb", F.lit("")).alias("value")).filter("op IS NOT NULL")


def placement_matches(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """For rows of ``a`` without a pair: the gap of ``b`` they belong in, between the mapped neighbours. (doc_id, pos, after, before)."""
    mapped = a.join(pairs.select("doc_id", F.col("base_id").alias("pos"), F.col("current_id").alias("to")), ["doc_id", "pos"], "left")
    w = Window.partitionBy("doc_id").orderBy("pos")
    near = mapped.withColumn("after", F.last("to", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.first("to", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return near.filter("to IS NULL").select("doc_id", "pos", "after", "before")


def suffix_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of section paths of which one ends like the other: joined on the last part, then compared as far as the shorter goes."""
    x, y = (df.select(F.col("path").alias(n)).distinct().withColumn("last", F.try_element_at(n, F.lit(-1))) for df, n in ((a, "a"), (b, "b")))
    n = F.least(F.size("a"), F.size("b"))
    tail = lambda c: F.slice(c, F.size(c) - n + 1, n)
    return x.join(y, "last").filter(tail("a") == tail("b")).select("a", "b")


def carry_meta(current: DataFrame, base: DataFrame, columns: list[str]) -> DataFrame:
    """Current nodes with the columns of the base node at the same locator where their own are null, else of the nth of their kind."""
    by_loc = base.select(*KEY, *(F.col(c).alias(f"loc_{c}") for c in columns))
    w = Window.partitionBy("doc_id", "kind").orderBy("pos")
    nth = lambda df: df.withColumn("nth", F.row_number().over(w))
    by_nth = nth(base).select("doc_id", "kind", "nth", *(F.col(c).alias(f"nth_{c}") for c in columns))
    j = nth(current).join(by_loc, KEY, "left").join(by_nth, ["doc_id", "kind", "nth"], "left")
    return j.select(*(c for c in current.columns if c not in columns), *(F.coalesce(c, f"loc_{c}", f"nth_{c}").alias(c) for c in columns))


def list_tree(items: DataFrame) -> DataFrame:
    """List rows (doc_id, pos, indent) with the position of their parent: the last row before with a smaller indent.

    A document's rows are folded in their order over the stack of rows still open, as deep as its indents go.
    """
    row = F.struct("pos", "indent")
    rows = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = items.select(row.alias("r")).schema["r"].dataType.simpleString()
    pos = items.schema["pos"].dataType.simpleString()

    def step(opened: Column, r: Column) -> tuple[Column, Column]:
        above = F.filter(opened, lambda x: x["indent"] < r["indent"])  # indents on the stack rise
        return F.concat(above, F.array(r)), F.array(F.struct(r["pos"].alias("pos"), F.try_element_at(above, F.lit(-1))["pos"].alias("parent")))

    found = fold(F.col("rows"), F.array().cast(f"array<{kind}>"), f"struct<pos:{pos},parent:{pos}>", step)
    return items.join(rows.select("doc_id", F.explode(found).alias("o")).select("doc_id", "o.pos", "o.parent"), ["doc_id", "pos"])


def render_blocks(nodes: DataFrame) -> DataFrame:
    """Nodes back to text, in order: code fenced, anything else as its value."""
    shown = F.when(F.col("kind") == "code", F.concat(F.lit("```\n"), F.col("value"), F.lit("\n```"))).otherwise(F.col("value"))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "locator", shown.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def callout_plan(l0: DataFrame, l1: DataFrame, r0: DataFrame, r1: DataFrame) -> DataFrame:
    """Callouts (doc_id, locator, ctype, title, value) of four versions to ops: create, adopt, delete, title, children, or blocked with a reason.

    A callout never changes its type in place; what the remote changed is never deleted.
    """
    known = lambda base, now: identified(base.withColumns({"kind": F.lit("callout"), "section": F.col("title")}), now.withColumns({"kind": F.lit("callout"), "section": F.col("title")}))
    parts = [df.select(*KEY, F.struct("ctype", "title", "value").alias(n)) for df, n in ((l0, "l0"), (known(l0, l1), "l1"), (r0, "r0"), (known(r0, r1), "r1"))]
    j = reduce(lambda a, b: a.join(b, KEY, "full_outer"), parts)
    has = {n: F.col(n).isNotNull() for n in ("l0", "l1", "r0", "r1")}
    added, removed, both = ~has["l0"] & has["l1"], has["l0"] & ~has["l1"], has["l0"] & has["l1"]
    untouched = F.col("r0").eqNullSafe(F.col("r1"))
    op = (
        F.when(added & ~has["r1"], "create").when(added & (F.col("r1") == F.col("l1")), "adopt").when(added, "blocked:taken")
        .when(removed & has["r1"] & untouched, "delete").when(removed & has["r1"], "blocked:changed-remotely")
        .when(both & (F.col("l0.ctype") != F.col("l1.ctype")), "blocked:type-change")
        .when(both & (F.col("l0") != F.col("l1")) & ~has["r1"], "blocked:missing-remotely")
        .when(both & (F.col("l0.title") != F.col("l1.title")), "title").when(both & (F.col("l0.value") != F.col("l1.value")), "children")
    )
    return j.select(*KEY, op.alias("op")).filter("op IS NOT NULL")


def callout_children(l0: DataFrame, l1: DataFrame, r1: DataFrame) -> DataFrame:
    """Child edits (doc_id, locator, ordinal, op, value) that bring the remote's children to the merged ones.

    Children (doc_id, locator, ordinal, value) meet by ordinal: a local change goes to an unchanged remote child; both changed is a conflict.
    """
    on = [*KEY, "ordinal"]
    b, l, r = (df.select(*on, F.col("value").alias(n)) for df, n in ((l0, "b"), (l1, "l"), (r1, "r")))  # noqa: E741
    j = b.join(l, on, "full_outer").join(r, on, "full_outer")
    local, remote = ~F.col("b").eqNullSafe(F.col("l")), ~F.col("b").eqNullSafe(F.col("r"))
    op = F.when(local & remote & ~F.col("l").eqNullSafe(F.col("r")), "conflict").when(local & ~remote, F.when(F.col("b").isNull(), "create").when(F.col("l").isNull(), "delete").otherwise("update"))
    return j.select(*on, op.alias("op"), F.coalesce("l", F.lit("")).alias("value")).filter("op IS NOT NULL")


def local_nodes(blocks: DataFrame) -> DataFrame:
    """Blocks with the node's kind: frontmatter, code, table, asset (a lone image), token (a lone component tag) or text."""
    text = F.col("text")
    kind = (
        F.when(F.col("kind").isin("code", "table"), F.col("kind")).when((F.col("first") == 0) & F.startswith("text", F.lit("--- ")), "frontmatter")
        .when(text.rlike(r"^!\[[^\]]*\]\([^)\s]+\)$"), "asset").when(text.rlike(r"^</?[A-Z][A-Za-z]*>$"), "token").otherwise("text")
    )
    return blocks.select("doc_id", "block_no", kind.alias("kind"), F.col("kind").alias("block_type"), "first", "text")


def remote_nodes(blocks: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Nodes from landed blocks (block_id, parent_id, payload, pos): kind by the block's type, opaque where unknown, ordinal among its kind below one parent."""
    kind = F.lit("opaque")
    for prefix, name in kinds.items():
        kind = F.when(F.startswith("block_id", F.lit(prefix)), name).otherwise(kind)
    rows = blocks.select("block_id", "parent_id", "pos", kind.alias("kind"), "payload").withColumn("hash", F.sha2(F.concat_ws("|", "kind", "payload"), 256)).drop("payload")
    return numbered(rows, ["parent_id", "kind"], ["pos", "block_id"]).select("block_id", "parent_id", "kind", "ordinal", "hash")


def code_plan_untracked(local: DataFrame, remote: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """Without a base: paired code of equal content is satisfied, of unequal content an update; the rest of a document with leftovers on both sides is ambiguous, else create or delete."""
    l = local.select("doc_id", F.col(id_col).alias("base_id"), F.col("value").alias("lv"))  # noqa: E741
    r = remote.select("doc_id", F.col(id_col).alias("current_id"), F.col("value").alias("rv"))
    paired = pairs.join(l, ["doc_id", "base_id"]).join(r, ["doc_id", "current_id"]).select("doc_id", F.col("base_id").alias("at"), F.when(F.col("lv") == F.col("rv"), "satisfied").otherwise("update").alias("op"))
    lone_l = l.join(pairs.select("doc_id", "base_id"), ["doc_id", "base_id"], "left_anti").select("doc_id", F.col("base_id").alias("at"), F.lit("create").alias("op"))
    lone_r = r.join(pairs.select("doc_id", "current_id"), ["doc_id", "current_id"], "left_anti").select("doc_id", F.col("current_id").alias("at"), F.lit("delete").alias("op"))
    both = lone_l.select("doc_id").intersect(lone_r.select("doc_id")).withColumn("both", F.lit(True))
    lone = lone_l.unionByName(lone_r).join(both, "doc_id", "left").select("doc_id", "at", F.when(F.col("both"), "ambiguous").otherwise(F.col("op")).alias("op"))
    return paired.unionByName(lone)
