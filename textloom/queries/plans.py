"""Plans over nodes of conversations as documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import lines as L
from textloom.plans import nodes as P
from textloom.queries import query
from textloom.queries.lines import _KINDS
from textloom.runtime import table
from textloom.sources import derived as D

_N = D.with_ctes("n_l1", "n_r1")
_I = D.with_ctes("i_n_l1", "i_n_r1")
_FOUR = f"""{_I}, keys AS (SELECT doc_id, locator FROM n0 UNION SELECT doc_id, locator FROM i_n_l1 UNION SELECT doc_id, locator FROM i_n_r1), f AS (SELECT k.doc_id, k.locator, a.value AS l0, b.value AS l1, a.value AS r0, c.value AS r1 FROM keys k
    LEFT JOIN n0 a ON a.doc_id = k.doc_id AND a.locator = k.locator LEFT JOIN i_n_l1 b ON b.doc_id = k.doc_id AND b.locator = k.locator LEFT JOIN i_n_r1 c ON c.doc_id = k.doc_id AND c.locator = k.locator)"""
#: Documents whose nodes can't be told apart or changed their order.
_REPEATS = "SELECT DISTINCT r.doc_id FROM (SELECT doc_id, value FROM n0 WHERE kind = 'text' GROUP BY 1, 2 HAVING count(*) > 1) r JOIN {s} s ON s.doc_id = r.doc_id AND s.kind = 'text' AND s.value = r.value WHERE (SELECT count(*) FROM n0 WHERE n0.doc_id = r.doc_id) <> (SELECT count(*) FROM {s} x WHERE x.doc_id = r.doc_id)"
_UNCLEAR = f"""rep AS ({_REPEATS.format(s='n_l1')} UNION {_REPEATS.format(s='n_r1')}), shared AS (SELECT a.doc_id, b.pos AS there, lag(b.pos) OVER (PARTITION BY a.doc_id ORDER BY a.pos, a.locator) AS before FROM i_n_l1 a JOIN i_n_r1 b USING (doc_id, locator) WHERE a.kind <> 'code' AND b.kind <> 'code' AND NOT starts_with(locator, 'new|')),
    unclear AS (SELECT doc_id, 'ambiguous-repeats' AS blocker FROM rep UNION ALL SELECT DISTINCT doc_id, 'order-changed' FROM shared WHERE before >= there AND doc_id NOT IN (SELECT doc_id FROM rep))"""
_PLAN = f"""{_FOUR}, plan AS (SELECT doc_id, locator, CASE WHEN l0 IS NULL AND l1 IS NOT NULL AND r1 IS NULL THEN 'create' WHEN l0 IS NOT NULL AND l1 IS NULL AND r1 IS NOT NULL AND r0 IS NOT DISTINCT FROM r1 THEN 'delete' WHEN l0 <> l1 AND r1 IS NOT NULL AND r0 IS NOT DISTINCT FROM r1 THEN 'update' END AS op,
    CASE WHEN l0 IS NULL AND l1 IS NOT NULL AND r1 <> l1 THEN 'taken' WHEN l0 IS NOT NULL AND l1 IS NULL AND r1 IS NOT NULL AND r0 IS DISTINCT FROM r1 THEN 'changed-remotely' WHEN l0 <> l1 AND r1 IS NULL THEN 'missing-remotely' WHEN l0 <> l1 AND r0 IS DISTINCT FROM r1 AND r1 <> l1 THEN 'changed-remotely' END AS blocker FROM f), {_UNCLEAR}, p AS (SELECT * FROM plan WHERE (op IS NOT NULL OR blocker IS NOT NULL) AND doc_id NOT IN (SELECT doc_id FROM unclear) UNION ALL SELECT doc_id, NULL, NULL, blocker FROM unclear)"""


def _four(spark, sf):
    base, local, remote = D.nodes(spark, sf)
    return base, local, base, remote


@query(f"{_PLAN} SELECT * FROM p")
def text_plan(spark, sf):
    return P.text_plan(*_four(spark, sf))


@query(f"{_FOUR} SELECT doc_id, locator, CASE WHEN l0 IS DISTINCT FROM l1 THEN l1 ELSE coalesce(r1, l1) END AS text, l0 IS DISTINCT FROM l1 AND r0 IS DISTINCT FROM r1 AND l1 IS DISTINCT FROM r1 AS conflict FROM f WHERE l1 IS NOT NULL")
def desired_text(spark, sf):
    return P.desired_text(*_four(spark, sf))


_SECTIONS = "s AS (SELECT DISTINCT doc_id, locator, section FROM (SELECT doc_id, locator, section FROM n0 UNION ALL SELECT doc_id, locator, section FROM i_n_l1))"


def _sections(spark, sf):
    base, local, _ = D.nodes(spark, sf)
    local = P.identified(base, local)
    return base.select("doc_id", "locator", "section").union(local.select("doc_id", "locator", "section")).distinct()


@query(f"{_PLAN}, {_SECTIONS} SELECT doc_id, coalesce(section, '') AS section, count(*) FILTER (WHERE op = 'create') AS create, count(*) FILTER (WHERE op = 'update') AS update, count(*) FILTER (WHERE op = 'delete') AS delete, string_agg(locator, ',' ORDER BY locator) AS locators FROM p LEFT JOIN s USING (doc_id, locator) WHERE op IS NOT NULL GROUP BY 1, 2")
def change_summary(spark, sf):
    return P.change_summary(P.text_plan(*_four(spark, sf)), _sections(spark, sf))


_TOKENS = """tl AS (SELECT doc_id, section, value, count(*) AS n, min(before) AS before FROM (SELECT *, last_value(CASE WHEN kind <> 'code' THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n_l1) WHERE kind = 'code' GROUP BY ALL),
    tr AS (SELECT doc_id, section, value, count(*) AS n, min(before) AS before FROM (SELECT *, last_value(CASE WHEN kind <> 'code' THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n_r1) WHERE kind = 'code' GROUP BY ALL),
    tp AS (SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(l.section, r.section) AS section, coalesce(l.value, r.value) AS value, CASE WHEN coalesce(l.n, 0) > 1 OR coalesce(r.n, 0) > 1 THEN 'blocked' WHEN r.n IS NULL THEN 'create' WHEN l.n IS NULL THEN 'delete' WHEN l.before IS DISTINCT FROM r.before THEN 'move' END AS op FROM tl l FULL JOIN tr r ON l.doc_id = r.doc_id AND l.section = r.section AND l.value = r.value)"""


@query(f"{_N}, {_TOKENS} SELECT * FROM tp WHERE op IS NOT NULL")
def token_plan(spark, sf):
    _, local, remote = D.nodes(spark, sf)
    return P.token_plan(local, remote)


@query(f"{_PLAN}, {_TOKENS}, every AS (SELECT doc_id, op, blocker, 'text' AS plan FROM p UNION ALL SELECT doc_id, CASE WHEN op <> 'blocked' THEN op END, CASE WHEN op = 'blocked' THEN op END, 'token' FROM tp WHERE op IS NOT NULL) SELECT doc_id, CASE WHEN count(blocker) > 0 THEN 0 ELSE count(op) END AS ops, count(blocker) AS blockers, string_agg(DISTINCT plan, ',' ORDER BY plan) AS plans FROM every GROUP BY doc_id")
def scoped_plan(spark, sf):
    base, local, _, remote = _four(spark, sf)
    tokens = P.token_plan(local, remote)
    blocked = F.col("op") == "blocked"
    return P.scoped_plan([("text", P.text_plan(base, local, base, remote)), ("token", tokens.select("doc_id", F.when(~blocked, F.col("op")).alias("op"), F.when(blocked, F.col("op")).alias("blocker")))])


@query(f"""{_N}, u1 AS (SELECT a.doc_id, a.pos AS base_id, b.pos AS current_id FROM n0 a JOIN n_l1 b USING (doc_id, section, value) WHERE (doc_id, section, value) IN (SELECT (doc_id, section, value) FROM n0 GROUP BY doc_id, section, value HAVING count(*) = 1) AND (doc_id, section, value) IN (SELECT (doc_id, section, value) FROM n_l1 GROUP BY doc_id, section, value HAVING count(*) = 1)),
    ra AS (SELECT * FROM n0 WHERE (doc_id, pos) NOT IN (SELECT (doc_id, base_id) FROM u1)), rb AS (SELECT * FROM n_l1 WHERE (doc_id, pos) NOT IN (SELECT (doc_id, current_id) FROM u1)), u2 AS (SELECT ra.doc_id, ra.pos AS base_id, rb.pos AS current_id FROM ra JOIN rb ON ra.doc_id = rb.doc_id AND ra.locator = rb.locator),
    la AS (SELECT doc_id, count(*) AS n, min(pos) AS pos FROM ra WHERE (doc_id, pos) NOT IN (SELECT (doc_id, base_id) FROM u2) GROUP BY doc_id), lb AS (SELECT doc_id, count(*) AS n, min(pos) AS pos FROM rb WHERE (doc_id, pos) NOT IN (SELECT (doc_id, current_id) FROM u2) GROUP BY doc_id)
    SELECT *, 'value' AS how FROM u1 UNION ALL SELECT *, 'locator' FROM u2 UNION ALL SELECT la.doc_id, la.pos, lb.pos, 'leftover' FROM la JOIN lb ON la.doc_id = lb.doc_id WHERE la.n = 1 AND lb.n = 1""")
def align_nodes(spark, sf):
    base, local, _ = D.nodes(spark, sf)
    pairs = P.align(base, local, ["doc_id"], [("value", ["section", "value"], True), ("locator", ["locator"], False)], "pos")
    return pairs.unionByName(P.single_leftover(base, local, pairs, ["doc_id"], "pos"))


_RES = """l AS (SELECT doc_id, section, count(*) AS n FROM n_l1 WHERE kind = 'code' GROUP BY 1, 2), r AS (SELECT doc_id, section, count(*) AS n, min(value) AS v FROM n_r1 WHERE kind = 'code' GROUP BY 1, 2), t AS (SELECT doc_id, section, sha256(min(value)) AS seen FROM n0 WHERE kind = 'code' AND doc_id % 4 <> 1 GROUP BY 1, 2)"""


@query(f"{_N}, {_RES}, j AS (SELECT coalesce(l.doc_id, r.doc_id, t.doc_id) AS doc_id, coalesce(l.section, r.section, t.section) AS section, l.n AS ln, r.n AS rn, r.v, seen FROM l FULL JOIN r ON l.doc_id = r.doc_id AND l.section = r.section FULL JOIN t ON t.doc_id = coalesce(l.doc_id, r.doc_id) AND t.section = coalesce(l.section, r.section)), s AS (SELECT doc_id, section, CASE WHEN ln IS NULL AND seen IS NOT NULL THEN 'removed' WHEN ln IS NULL THEN NULL WHEN ln > 1 OR coalesce(rn, 0) > 1 THEN 'ambiguous' WHEN rn IS NULL THEN 'missing' WHEN seen IS NULL THEN 'adopt' WHEN sha256(v) = seen THEN 'protect' ELSE 'changed' END AS state FROM j) SELECT * FROM s WHERE state IS NOT NULL")
def resource_plan(spark, sf):
    base, local, remote = (df.filter("kind = 'code'") for df in D.nodes(spark, sf))
    receipts = base.filter("doc_id % 4 <> 1").groupBy("doc_id", "section").agg(F.sha2(F.min("value"), 256).alias("hash"))
    return P.resource_plan(local, remote, receipts, ["doc_id", "section"])


_ASSET = "SELECT 'a' || CAST(p_partkey AS VARCHAR(20)) AS asset, {h} AS hash FROM part WHERE p_partkey % {m} <> {r}"
_A = [_ASSET.format(h="CASE WHEN p_partkey % 5 = 1 THEN 'new' ELSE 'old' END", m=11, r=2), _ASSET.format(h="CASE WHEN p_partkey % 7 = 1 THEN 'edited' ELSE 'old' END", m=13, r=3), _ASSET.format(h="'old'", m=6, r=4)]


@query(f"WITH l AS ({_A[0]}), r AS ({_A[1]}), t AS ({_A[2]}), j AS (SELECT coalesce(l.asset, r.asset) AS asset, l.hash AS now, r.hash AS there, t.hash AS seen FROM l FULL JOIN r ON l.asset = r.asset LEFT JOIN t ON t.asset = coalesce(l.asset, r.asset)), s AS (SELECT *, CASE WHEN now IS NULL THEN CASE WHEN seen IS NOT NULL THEN 'missing' END WHEN seen IS NULL THEN 'untracked' WHEN there IS NULL THEN 'missing' WHEN now <> seen AND there <> seen THEN 'conflict' WHEN now <> seen THEN 'local-changed' WHEN there <> seen THEN 'remote-changed' ELSE 'clean' END AS state FROM j) SELECT asset, state, CASE WHEN now IS NULL THEN 'none' WHEN state = 'untracked' AND there IS NULL THEN 'create' WHEN state = 'untracked' THEN 'adopt' WHEN state = 'missing' THEN 'create' WHEN state = 'local-changed' THEN 'update' WHEN state IN ('conflict', 'remote-changed') THEN CASE WHEN asset = 'a8' THEN 'overwrite' ELSE 'protect' END ELSE 'none' END AS action FROM s WHERE state IS NOT NULL")
def asset_plan(spark, sf):
    l, r, t = (spark.sql(q.replace("FROM part", "FROM {p}"), p=table(spark, sf, "part")) for q in _A)  # noqa: E741
    return P.asset_plan(l, r, t.select("asset", F.col("hash").alias("local_hash"), F.col("hash").alias("remote_hash")), ["a8"])


@query(f"{_FOUR}, k AS (SELECT doc_id, locator, l1 IS NOT NULL AS here, CASE WHEN l1 IS NOT NULL AND r1 IS NULL THEN 'local-only' WHEN l1 IS NULL AND r1 IS NOT NULL THEN 'remote-only' WHEN l1 <> r1 THEN 'divergent' END AS kind FROM f) SELECT doc_id, locator, kind, CASE WHEN doc_id % 9 = 2 AND here THEN 'blocked' ELSE 'repairable' END AS state FROM k WHERE kind IS NOT NULL")
def loss_report(spark, sf):
    base, local, remote = D.nodes(spark, sf)
    local, remote = P.identified(base, local), P.identified(base, remote)
    later = local.withColumn("value", F.when(F.col("doc_id") % 9 == 2, F.concat("value", F.lit(" later"))).otherwise(F.col("value")))
    return P.loss_report(local, later, remote, remote)


@query(f"{_FOUR}, g AS (SELECT doc_id, locator, l0, l1, r1 AS r FROM f) SELECT doc_id, count(*) FILTER (WHERE l0 IS NOT DISTINCT FROM r) AS matching, count(*) FILTER (WHERE l0 IS DISTINCT FROM r) AS divergent, count(*) FILTER (WHERE l0 IS DISTINCT FROM l1) AS pending, bool_and(l0 IS NOT DISTINCT FROM r) AS safe, sha256(string_agg(concat_ws('|', locator, coalesce(l0, '-'), coalesce(l1, '-'), coalesce(r, '-')), chr(10) ORDER BY concat_ws('|', locator, coalesce(l0, '-'), coalesce(l1, '-'), coalesce(r, '-')))) AS fingerprint FROM g GROUP BY doc_id")
def adoption_report(spark, sf):
    base, local, remote = D.nodes(spark, sf)
    return P.adoption_report(base, local, P.identified(base, remote))


@query(f"{_N}, a AS (SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY pos) AS ordinal, value FROM n0 WHERE NOT (section = 'user' AND doc_id % 2 = 0)), b AS (SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY pos) AS ordinal, value FROM n_l1 WHERE NOT (section = 'user' AND doc_id % 2 = 0)) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.section, b.section) AS section, coalesce(a.ordinal, b.ordinal) AS ordinal, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' ELSE 'updated' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.section = b.section AND a.ordinal = b.ordinal WHERE a.value IS DISTINCT FROM b.value")
def scope_audit(spark, sf):
    base, local, _ = D.nodes(spark, sf)
    return P.scope_audit(base, local, base.filter("section = 'user' AND doc_id % 2 = 0"))


@query(f"{_N}, d AS (SELECT doc_id, kind AS code, CASE WHEN (doc_id + pos) % 9 = 0 THEN 'blocker' ELSE 'warning' END AS severity FROM n0) SELECT doc_id, count(DISTINCT code || severity) AS findings, bool_and(severity <> 'blocker') AS safe_to_publish FROM d GROUP BY doc_id")
def round_trip_report(spark, sf):
    base, _, _ = D.nodes(spark, sf)
    return P.round_trip_report(base.select("doc_id", F.col("kind").alias("code"), F.when((F.col("doc_id") + F.col("pos")) % 9 == 0, "blocker").otherwise("warning").alias("severity")))


@query(f"{_N} SELECT DISTINCT doc_id, kind, section FROM n0")
def dedupe_diagnostics(spark, sf):
    return P.dedupe_diagnostics(D.nodes(spark, sf)[0], ["doc_id", "kind", "section"])


@query(f"{_N} SELECT doc_id, section, kind, count(*) AS n, count(*) > 1 AS ambiguous FROM n_l1 GROUP BY doc_id, section, kind")
def identity_counts(spark, sf):
    return P.identity_counts(D.nodes(spark, sf)[1], ["doc_id", "section", "kind"])


@query(f"""{_N}, a AS (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS "at" FROM n_r1), b AS (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS "at" FROM n_l1),
    ua AS (SELECT doc_id, value, min("at") AS ra FROM a GROUP BY 1, 2 HAVING count(*) = 1), ub AS (SELECT doc_id, value, min("at") AS rb FROM b GROUP BY 1, 2 HAVING count(*) = 1), an0 AS (SELECT doc_id, ra, rb FROM ua JOIN ub USING (doc_id, value)),
    an AS (SELECT x.doc_id, x.ra, x.rb FROM an0 x WHERE NOT EXISTS (SELECT 1 FROM an0 y WHERE y.doc_id = x.doc_id AND ((y.ra < x.ra AND y.rb > x.rb) OR (y.ra > x.ra AND y.rb < x.rb)))),
    ga AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gap ORDER BY "at") AS nth FROM (SELECT a.*, an.ra AS anchor, (SELECT count(*) FROM an z WHERE z.doc_id = a.doc_id AND z.ra <= a."at") AS gap FROM a LEFT JOIN an ON an.doc_id = a.doc_id AND an.ra = a."at") WHERE anchor IS NULL),
    gb AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gap ORDER BY "at") AS nth FROM (SELECT b.*, an.rb AS anchor, (SELECT count(*) FROM an z WHERE z.doc_id = b.doc_id AND z.rb <= b."at") AS gap FROM b LEFT JOIN an ON an.doc_id = b.doc_id AND an.rb = b."at") WHERE anchor IS NULL),
    o AS (SELECT coalesce(ga.doc_id, gb.doc_id) AS doc_id, CASE WHEN ga."at" IS NULL THEN 'create' WHEN gb."at" IS NULL THEN 'delete' WHEN ga.value <> gb.value THEN 'update' END AS op, coalesce(ga."at", gb."at") AS "at", coalesce(gb.value, '') AS value FROM ga FULL JOIN gb ON ga.doc_id = gb.doc_id AND ga.gap = gb.gap AND ga.nth = gb.nth)
    SELECT * FROM o WHERE op IS NOT NULL""")
def block_patch(spark, sf):
    _, local, remote = D.nodes(spark, sf)
    return P.block_patch(remote, local)


@query(f"{_N}, m AS (SELECT a.doc_id, a.pos, b.pos AS t FROM n_l1 a LEFT JOIN n0 b ON a.doc_id = b.doc_id AND a.locator = b.locator), w AS (SELECT doc_id, pos, t, last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after, first_value(t IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS before FROM m) SELECT doc_id, pos, after, before FROM w WHERE t IS NULL")
def placement_matches(spark, sf):
    base, local, _ = D.nodes(spark, sf)
    pairs = local.select("doc_id", "locator", F.col("pos").alias("base_id")).join(base.select("doc_id", "locator", F.col("pos").alias("current_id")), ["doc_id", "locator"])
    return P.placement_matches(local, base, pairs)


@query("WITH a AS (SELECT DISTINCT ['x' || n_regionkey, 'n' || n_nationkey % 6] AS p FROM nation), b AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN ['n' || n_nationkey % 6] ELSE ['top', 'x' || n_regionkey % 2, 'n' || n_nationkey % 6] END AS q FROM nation), j AS (SELECT p, q, least(len(p), len(q)) AS n FROM a, b WHERE p[-1] = q[-1]) SELECT array_to_string(p, '/') AS a, array_to_string(q, '/') AS b FROM j WHERE p[len(p) - n + 1:] = q[len(q) - n + 1:]")
def suffix_paths(spark, sf):
    n = table(spark, sf, "nation")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    last = name("n", F.col("n_nationkey") % 6)
    a = n.select(F.array(name("x", F.col("n_regionkey")), last).alias("path"))
    b = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.array(last)).otherwise(F.array(F.lit("top"), name("x", F.col("n_regionkey") % 2), last)).alias("path"))
    return P.suffix_paths(a, b).select(F.array_join("a", "/").alias("a"), F.array_join("b", "/").alias("b"))


@query(f"{_N}, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS nth FROM n0), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS nth FROM n_l1) SELECT c.doc_id, c.pos, c.locator, coalesce(CASE WHEN c.pos % 20 = 0 THEN c.value END, l.value, n.value) AS value FROM c LEFT JOIN b l ON l.doc_id = c.doc_id AND l.locator = c.locator LEFT JOIN b n ON n.doc_id = c.doc_id AND n.kind = c.kind AND n.nth = c.nth")
def carry_meta(spark, sf):
    base, local, _ = D.nodes(spark, sf)
    current = local.withColumn("value", F.when(F.col("pos") % 20 == 0, F.col("value")))
    return P.carry_meta(current, base, ["value"]).select("doc_id", "pos", "locator", "value")


@query(f"{_N}, i AS (SELECT doc_id, pos, (doc_id + pos // 10 * 2) % 4 AS indent FROM n0) SELECT doc_id, pos, indent, (SELECT max(y.pos) FROM i y WHERE y.doc_id = i.doc_id AND y.pos < i.pos AND y.indent < i.indent) AS parent FROM i")
def list_tree(spark, sf):
    items = D.nodes(spark, sf)[0].select("doc_id", "pos", ((F.col("doc_id") + F.floor(F.col("pos") / 10) * 2) % 4).alias("indent"))
    return P.list_tree(items)


@query(f"{_N} SELECT doc_id, string_agg(CASE WHEN kind = 'code' THEN '```' || chr(10) || value || chr(10) || '```' ELSE value END, chr(10) || chr(10) ORDER BY pos, locator) AS text FROM n_l1 GROUP BY doc_id")
def render_blocks(spark, sf):
    return P.render_blocks(D.nodes(spark, sf)[1])


_C = f"""{_N}, s0 AS (SELECT *, kind AS ctype, section AS title, 'callout' AS k2 FROM n0), s1 AS (SELECT *, CASE WHEN pos % 70 = 10 THEN 'other' ELSE kind END AS ctype, CASE WHEN pos % 40 = 20 THEN 'renamed' ELSE section END AS title FROM n_l1), s2 AS (SELECT *, kind AS ctype, section AS title FROM n_r1),
    e0 AS (SELECT * EXCLUDE (k2) REPLACE ('callout' AS kind, title AS section) FROM s0), e1 AS (SELECT * REPLACE ('callout' AS kind, title AS section) FROM s1), e2 AS (SELECT * REPLACE ('callout' AS kind, title AS section) FROM s2), {D.identified_cte('e1', 'e0')}, {D.identified_cte('e2', 'e0')},
    c0 AS (SELECT doc_id, locator, ctype, title, value FROM e0), c1 AS (SELECT doc_id, locator, ctype, title, value FROM i_e1), cr AS (SELECT doc_id, locator, ctype, title, value FROM i_e2),
    ck AS (SELECT doc_id, locator FROM c0 UNION SELECT doc_id, locator FROM c1 UNION SELECT doc_id, locator FROM cr), cj AS (SELECT k.doc_id, k.locator, a.value AS v0, a.ctype AS t0, a.title AS h0, b.value AS v1, b.ctype AS t1, b.title AS h1, r.value AS vr, r.ctype AS tr, r.title AS hr FROM ck k
    LEFT JOIN c0 a ON a.doc_id = k.doc_id AND a.locator = k.locator LEFT JOIN c1 b ON b.doc_id = k.doc_id AND b.locator = k.locator LEFT JOIN cr r ON r.doc_id = k.doc_id AND r.locator = k.locator)"""


@query(f"""{_C}, o AS (SELECT doc_id, locator, CASE WHEN v0 IS NULL AND v1 IS NOT NULL THEN CASE WHEN vr IS NULL THEN 'create' WHEN vr = v1 AND tr = t1 AND hr = h1 THEN 'adopt' ELSE 'blocked:taken' END
    WHEN v0 IS NOT NULL AND v1 IS NULL THEN CASE WHEN vr IS NOT NULL THEN CASE WHEN vr = v0 AND tr = t0 AND hr = h0 THEN 'delete' ELSE 'blocked:changed-remotely' END END
    WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN CASE WHEN t0 <> t1 THEN 'blocked:type-change' WHEN (v0 <> v1 OR h0 <> h1) AND vr IS NULL THEN 'blocked:missing-remotely' WHEN h0 <> h1 THEN 'title' WHEN v0 <> v1 THEN 'children' END END AS op FROM cj) SELECT * FROM o WHERE op IS NOT NULL""")
def callout_plan(spark, sf):
    base, local, remote = (df.select("doc_id", "locator", "pos", F.col("kind").alias("ctype"), F.col("section").alias("title"), "value") for df in D.nodes(spark, sf))
    local = local.withColumn("ctype", F.when(F.col("pos") % 70 == 10, "other").otherwise(F.col("ctype"))).withColumn("title", F.when(F.col("pos") % 40 == 20, "renamed").otherwise(F.col("title")))
    return P.callout_plan(base, local, base, remote)


def _words(df):
    return df.select("doc_id", "locator", F.posexplode(F.split("value", " ")).alias("ordinal", "value"))


_W = "SELECT doc_id, locator, unnest(range(len(a))) AS ordinal, unnest(a) AS value FROM (SELECT doc_id, locator, string_split(value, ' ') AS a FROM {t})"


@query(f"{_N}, b AS ({_W.format(t='n0')}), l AS ({_W.format(t='n_l1')}), r AS ({_W.format(t='n_r1')}), k AS (SELECT doc_id, locator, ordinal FROM b UNION SELECT doc_id, locator, ordinal FROM l UNION SELECT doc_id, locator, ordinal FROM r), j AS (SELECT k.*, b.value AS b, l.value AS l, r.value AS r FROM k LEFT JOIN b USING (doc_id, locator, ordinal) LEFT JOIN l USING (doc_id, locator, ordinal) LEFT JOIN r USING (doc_id, locator, ordinal)), o AS (SELECT doc_id, locator, ordinal, CASE WHEN b IS DISTINCT FROM l AND b IS DISTINCT FROM r AND l IS DISTINCT FROM r THEN 'conflict' WHEN b IS DISTINCT FROM l AND b IS NOT DISTINCT FROM r THEN CASE WHEN b IS NULL THEN 'create' WHEN l IS NULL THEN 'delete' ELSE 'update' END END AS op, coalesce(l, '') AS value FROM j) SELECT * FROM o WHERE op IS NOT NULL")
def callout_children(spark, sf):
    base, local, remote = D.nodes(spark, sf)
    return P.callout_children(_words(base), _words(local), _words(remote))


@query(_KINDS + " SELECT doc_id, block_no, kind AS block_type, first, sha256(text) AS text_hash, CASE WHEN kind IN ('code', 'table') THEN kind WHEN first = 0 AND starts_with(text, '--- ') THEN 'frontmatter' WHEN regexp_matches(text, '^!\\[[^\\]]*\\]\\([^)\\s]+\\)$') THEN 'asset' WHEN regexp_matches(text, '^</?[A-Z][A-Za-z]*>$') THEN 'token' ELSE 'text' END AS kind FROM blocks")
def local_nodes(spark, sf):
    return P.local_nodes(L.extract_blocks(D.rich(spark, sf))).withColumn("text_hash", F.sha2("text", 256)).drop("text")


@query(f"{D.with_ctes('tree')}, k AS (SELECT *, CASE substr(block_id, 1, 1) WHEN 'n' THEN 'heading' WHEN 'c' THEN 'table' WHEN 'o' THEN 'text' ELSE 'opaque' END AS kind FROM tree) SELECT block_id, parent_id, kind, row_number() OVER (PARTITION BY parent_id, kind ORDER BY pos, block_id) - 1 AS ordinal, sha256(kind || '|' || payload) AS hash FROM k")
def remote_nodes(spark, sf):
    return P.remote_nodes(D.tree(spark, sf), {"n": "heading", "c": "table", "o": "text"})


@query(f"""{_N}, u AS (SELECT a.doc_id, a.pos AS b, c.pos AS c FROM n_l1 a JOIN n_r1 c ON a.doc_id = c.doc_id AND a.locator = c.locator WHERE a.kind = 'code' AND c.kind = 'code'), s AS (SELECT u.doc_id, b AS "at", CASE WHEN a.value = c.value THEN 'satisfied' ELSE 'update' END AS op FROM u JOIN n_l1 a ON a.doc_id = u.doc_id AND a.pos = u.b JOIN n_r1 c ON c.doc_id = u.doc_id AND c.pos = u.c),
    ll AS (SELECT doc_id, pos FROM n_l1 WHERE kind = 'code' AND (doc_id, pos) NOT IN (SELECT (doc_id, b) FROM u)), lr AS (SELECT doc_id, pos FROM n_r1 WHERE kind = 'code' AND (doc_id, pos) NOT IN (SELECT (doc_id, c) FROM u)), two AS (SELECT doc_id FROM ll INTERSECT SELECT doc_id FROM lr)
    SELECT * FROM s UNION ALL SELECT doc_id, pos, CASE WHEN doc_id IN (SELECT doc_id FROM two) THEN 'ambiguous' ELSE 'create' END FROM ll UNION ALL SELECT doc_id, pos, CASE WHEN doc_id IN (SELECT doc_id FROM two) THEN 'ambiguous' ELSE 'delete' END FROM lr""")
def code_plan_untracked(spark, sf):
    _, local, remote = (df.filter("kind = 'code'") for df in D.nodes(spark, sf))
    pairs = P.align(local, remote, ["doc_id"], [("locator", ["locator"], False)], "pos")
    return P.code_plan_untracked(local, remote, pairs, "pos")
