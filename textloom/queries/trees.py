"""Block trees and operation logs, on the tree of regions, nations, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import audits as A
from textloom.operators import trees as R
from textloom.queries import query
from textloom.runtime import materialize, table
from textloom.sources import derived as D

_HASH = "sha256(block_id || '|' || payload)"
_TREE = D.with_ctes("tree")
_WALK = f"""{_TREE}, walk AS (SELECT block_id, parent_id, 0 AS depth, lpad(CAST(pos AS VARCHAR), 12, '0') || ':' || block_id AS path FROM tree WHERE parent_id IS NULL
    UNION ALL SELECT t.block_id, t.parent_id, depth + 1, path || '/' || lpad(CAST(t.pos AS VARCHAR), 12, '0') || ':' || t.block_id FROM tree t JOIN walk w ON t.parent_id = w.block_id)"""
#: One op of every order. Some repeat an id, name a wrong target, hash, parent or anchor, or change nothing.
_OPS = """SELECT batch, op_seq, op_id, kind, CASE WHEN k % 70 = 1 THEN 'root' WHEN k % 70 = 2 THEN 'zz' || s WHEN kind = 'insert' AND k % 7 <> 0 THEN 'i' || s ELSE 'o' || s END AS target_id,
    CASE WHEN k % 30 = 2 THEN 'wrong' WHEN k % 4 = 0 OR kind = 'insert' THEN CAST(NULL AS VARCHAR(64)) ELSE {sha} END AS expected_hash, CASE WHEN kind = 'replace' THEN CAST(NULL AS VARCHAR(20)) WHEN k % 40 = 3 THEN 'zz' WHEN k % 40 = 7 THEN 'n1' ELSE c END AS parent_id,
    CASE WHEN kind NOT IN ('insert', 'move') THEN CAST(NULL AS VARCHAR(20)) WHEN k % 11 = 0 THEN 'o' || s WHEN k % 11 = 1 THEN 'gone' WHEN k % 11 = 2 THEN 'n1' WHEN k % 11 < 5 THEN coalesce('o' || CAST(back1 AS VARCHAR(20)), c) WHEN k % 11 < 8 THEN coalesce('o' || CAST(back2 AS VARCHAR(20)), c) ELSE c END AS after_id,
    CASE WHEN kind = 'insert' AND k % 3 = 0 THEN 'o' || s END AS before_id
    FROM (SELECT 'b' || CAST(o_custkey AS VARCHAR(20)) AS batch, CAST(o_orderkey AS BIGINT) AS op_seq, CASE WHEN o_orderkey % 500 = 1 THEN 'dup' ELSE 'op' || CAST(o_orderkey AS VARCHAR(20)) END AS op_id, CASE o_orderkey % 6 WHEN 0 THEN 'replace' WHEN 3 THEN 'insert' WHEN 1 THEN 'delete' WHEN 4 THEN 'delete' ELSE 'move' END AS kind,
        o_orderkey AS k, CAST(o_orderkey AS VARCHAR(20)) AS s, 'c' || CAST(o_custkey AS VARCHAR(20)) AS c, o_orderpriority, lag(o_orderkey) OVER w AS back1, lag(o_orderkey, 2) OVER w AS back2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) log"""
_OPS_DUCK = _OPS.format(sha="sha256('o' || s || '|' || o_orderpriority)")
_LOG = f"{_TREE}, ops AS ({_OPS_DUCK}), nodes AS (SELECT block_id, parent_id, pos, {_HASH} AS hash FROM tree)"
_AFTER = "after AS (SELECT block_id, parent_id, CASE WHEN block_id LIKE 'o%' AND pos % 53 = 2 THEN pos - 100000000000 ELSE pos END AS pos, CASE WHEN pos % 97 = 5 THEN 'new' ELSE hash END AS hash FROM nodes WHERE NOT (block_id LIKE 'o%' AND pos % 89 = 3) UNION ALL SELECT 'x' || pos, block_id, 0, 'added' FROM nodes WHERE block_id LIKE 'c%' AND pos % 41 = 0)"
_NEAR = "SELECT block_id, parent_id, hash, lag(block_id) OVER w AS previous, lead(block_id) OVER w AS following FROM {t} WINDOW w AS (PARTITION BY parent_id ORDER BY pos, block_id)"
_FIRST = "SELECT parent_id, block_id AS first FROM {near} WHERE previous IS NULL AND parent_id IS NOT NULL"


def _nodes(spark, sf):
    return D.tree(spark, sf).select("block_id", "parent_id", "pos", F.sha2(F.concat_ws("|", "block_id", "payload"), 256).alias("hash"))


def _after(nodes):
    moved = F.when(F.col("block_id").like("o%") & (F.col("pos") % 53 == 2), F.col("pos") - 100_000_000_000).otherwise(F.col("pos"))
    kept = nodes.filter("NOT (block_id LIKE 'o%' AND pos % 89 = 3)").select("block_id", "parent_id", moved.alias("pos"), F.when(F.col("pos") % 97 == 5, "new").otherwise(F.col("hash")).alias("hash"))
    added = nodes.filter("block_id LIKE 'c%' AND pos % 41 = 0").select(F.concat(F.lit("x"), F.col("pos").cast("string")).alias("block_id"), F.col("block_id").alias("parent_id"), F.lit(0).cast("long").alias("pos"), F.lit("added").alias("hash"))
    return kept.unionByName(added)


def _ops(spark, sf):
    sql = _OPS.format(sha="sha2('o' || s || '|' || o_orderpriority, 256)").replace("FROM orders", "FROM {o}")
    return spark.sql(sql, o=table(spark, sf, "orders"))


@query(f"{_WALK} SELECT block_id, depth, row_number() OVER (ORDER BY path) - 1 AS n FROM walk")
def preorder(spark, sf):
    return R.preorder(D.tree(spark, sf))


@query(f"{_WALK}, kids AS (SELECT parent_id AS block_id, count(*) AS n FROM tree WHERE parent_id IS NOT NULL GROUP BY 1) SELECT t.block_id, t.parent_id, depth, CASE substr(t.block_id, 1, 1) WHEN 'n' THEN 'nation' WHEN 'c' THEN 'customer' WHEN 'o' THEN 'order' ELSE 'other' END AS kind, sha256(t.block_id || '|' || payload) AS node_hash, coalesce(n, 0) AS n_children FROM tree t JOIN walk w ON w.block_id = t.block_id LEFT JOIN kids ON kids.block_id = t.block_id")
def flatten_snapshot(spark, sf):
    return R.flatten_snapshot(D.tree(spark, sf), {"n": "nation", "c": "customer", "o": "order"})


#: Declared parents and lists of children that contradict each other in places.
_DECLARED = "SELECT block_id, CASE WHEN block_id LIKE 'o%' AND pos % 70 = 9 THEN 'c1' WHEN block_id LIKE 'o%' AND pos % 70 = 10 THEN 'nowhere' ELSE parent_id END AS parent_id, pos FROM tree UNION ALL SELECT block_id, parent_id, pos FROM tree WHERE block_id LIKE 'o%' AND pos % 80 = 11 UNION ALL SELECT 'root2', CAST(NULL AS VARCHAR(9)), 1 FROM tree WHERE block_id = 'root'"
_LISTS = """SELECT CASE WHEN block_id = 'c8' THEN 'c9' WHEN block_id = 'c9' THEN 'c8' ELSE parent_id END AS parent_id, CASE WHEN block_id LIKE 'o%' AND pos % 90 = 17 THEN 'gone' || CAST(pos AS VARCHAR(20)) ELSE block_id END AS child_id FROM tree WHERE parent_id IS NOT NULL AND NOT (block_id LIKE 'c%' AND pos % 60 = 7)
    UNION ALL SELECT parent_id, block_id FROM tree WHERE block_id LIKE 'o%' AND pos % 80 = 12 UNION ALL SELECT 'root', block_id FROM tree WHERE block_id LIKE 'o%' AND pos % 90 = 13 UNION ALL SELECT 'n1', 'root'"""


@query(f"""{_TREE}, blocks AS ({_DECLARED}), refs AS (SELECT parent_id, child_id, count(*) AS n FROM ({_LISTS}) GROUP BY 1, 2), there AS (SELECT * FROM refs WHERE child_id IN (SELECT block_id FROM blocks)), listers AS (SELECT child_id AS block_id, count(*) AS parents, min(parent_id) AS lister FROM there GROUP BY 1),
    walk AS (SELECT block_id FROM blocks WHERE parent_id IS NULL UNION SELECT child_id FROM there JOIN walk w ON parent_id = w.block_id)
    SELECT block_id, 'duplicate-id' AS fault FROM blocks GROUP BY block_id HAVING count(*) > 1 UNION SELECT block_id, 'missing-parent' FROM blocks WHERE parent_id = 'nowhere' UNION SELECT parent_id, 'missing-child' FROM refs WHERE starts_with(child_id, 'gone') UNION SELECT parent_id, 'duplicate-child' FROM refs WHERE n > 1
    UNION SELECT block_id, 'conflicting-parents' FROM listers WHERE parents > 1 UNION SELECT block_id, 'root-referenced' FROM listers WHERE block_id = 'root' UNION SELECT block_id, 'unreferenced' FROM blocks ANTI JOIN listers USING (block_id) WHERE parent_id IS NOT NULL
    UNION SELECT block_id, 'parent-disagrees' FROM blocks JOIN listers USING (block_id) WHERE parents = 1 AND lister <> parent_id UNION SELECT block_id, 'unreachable' FROM blocks WHERE block_id NOT IN (SELECT block_id FROM walk)
    UNION SELECT block_id, 'several-roots' FROM blocks WHERE parent_id IS NULL AND (SELECT count(DISTINCT block_id) FROM blocks WHERE parent_id IS NULL) > 1""")
def validate_snapshot(spark, sf):
    tree = D.tree(spark, sf)
    return R.validate_snapshot(spark.sql(_DECLARED.replace("FROM tree", "FROM {t}"), t=tree), spark.sql(_LISTS.replace("FROM tree", "FROM {t}"), t=tree))


@query(f"{_TREE} SELECT parent_id, sha256(string_agg({_HASH}, ',' ORDER BY pos, block_id)) AS hash, count(*) AS n FROM tree WHERE parent_id IS NOT NULL GROUP BY parent_id")
def snapshot_hash(spark, sf):
    return R.snapshot_hash(D.tree(spark, sf), "parent_id")


_REFS = "SELECT 'c' || CAST(o_custkey AS VARCHAR(20)) AS parent_id, CAST(o_orderkey % 1000 AS BIGINT) AS ordinal, CASE WHEN o_orderkey % 25 = 0 THEN 'gone' || CAST(o_orderkey AS VARCHAR(20)) ELSE 'o' || CAST(o_orderkey AS VARCHAR(20)) END AS child_id FROM orders"


@query(f"{_TREE}, refs AS ({_REFS}) SELECT refs.parent_id, ordinal, child_id, payload, block_id IS NOT NULL AS found FROM refs LEFT JOIN tree ON block_id = child_id")
def resolve_children(spark, sf):
    return R.resolve_children(D.tree(spark, sf), spark.sql(_REFS.replace("FROM orders", "FROM {o}"), o=table(spark, sf, "orders")))


@query(f"{_TREE} SELECT block_id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY pos, block_id) - 1 AS ordinal FROM tree")
def ordered_children(spark, sf):
    return R.ordered_children(D.tree(spark, sf))


@query(f"{_WALK}, d AS (SELECT 'n' || n_nationkey AS top FROM nation WHERE n_nationkey % 5 = 0) SELECT top, block_id FROM d JOIN walk ON contains(path || '/', ':' || top || '/')")
def descendants(spark, sf):
    tops = table(spark, sf, "nation").filter("n_nationkey % 5 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("block_id"))
    return R.descendants(D.tree(spark, sf), tops)


_J = f"""{_LOG}, near AS ({_NEAR.format(t="nodes")}), firsts AS ({_FIRST.format(near="near")}), j AS (SELECT ops.*, n.block_id IS NOT NULL AS found, n.parent_id AS t_parent, n.hash, n.previous, p.block_id IS NOT NULL AS p, a.block_id IS NOT NULL AS a, a.parent_id AS a_parent, a.following, first, count(*) OVER (PARTITION BY op_id) AS copies
    FROM ops LEFT JOIN near n ON n.block_id = target_id LEFT JOIN nodes p ON p.block_id = ops.parent_id LEFT JOIN near a ON a.block_id = after_id LEFT JOIN firsts f ON f.parent_id = ops.parent_id)"""


@query(f"""{_J}, v AS (SELECT op_id, op_seq, unnest([CASE WHEN copies > 1 THEN 'duplicate-op' END, CASE WHEN kind = 'insert' AND count(*) FILTER (WHERE kind = 'insert') OVER (PARTITION BY target_id) > 1 THEN 'inserted-twice' END, CASE WHEN kind = 'insert' AND found THEN 'target-exists' WHEN kind <> 'insert' AND NOT found THEN 'missing-target' END, CASE WHEN kind <> 'insert' AND found AND expected_hash <> hash THEN 'hash-mismatch' END, CASE WHEN kind <> 'insert' AND found AND t_parent IS NULL THEN 'root-change' END,
        CASE WHEN kind <> 'replace' AND NOT p THEN 'missing-parent' END, CASE WHEN kind IN ('delete', 'move') AND found AND p AND t_parent IS DISTINCT FROM parent_id THEN 'not-a-child' END, CASE WHEN after_id <> parent_id AND NOT a THEN 'missing-anchor' END, CASE WHEN after_id <> parent_id AND a AND a_parent IS DISTINCT FROM parent_id THEN 'anchor-not-child' END,
        CASE WHEN kind = 'move' AND after_id = target_id THEN 'moving-anchor' END, CASE WHEN (after_id = parent_id AND before_id IS DISTINCT FROM first OR after_id <> parent_id AND a_parent = parent_id AND before_id IS DISTINCT FROM following) AND before_id IS NOT NULL THEN 'not-adjacent' END,
        CASE WHEN kind = 'move' AND t_parent = parent_id AND coalesce(previous, parent_id) = after_id THEN 'same-place' END]) AS fault FROM j) SELECT * FROM v WHERE fault IS NOT NULL""")
def validate_ops(spark, sf):
    return A.validate_ops(_ops(spark, sf), _nodes(spark, sf))


_CONDITIONS = f"""{_J}, conds AS (SELECT op_id, op_seq, target_id, 'exists' AS what, 'true' AS wanted FROM j WHERE kind <> 'insert' UNION ALL SELECT op_id, op_seq, target_id, 'hash', expected_hash FROM j WHERE kind <> 'insert' AND expected_hash IS NOT NULL
    UNION ALL SELECT op_id, op_seq, target_id, 'parent', parent_id FROM j WHERE kind IN ('delete', 'move') UNION ALL SELECT op_id, op_seq, parent_id, 'first', coalesce(first, '') FROM j WHERE after_id = parent_id UNION ALL SELECT op_id, op_seq, after_id, 'next', coalesce(following, '') FROM j WHERE after_id <> parent_id)"""


@query(f"{_CONDITIONS} SELECT op_id, op_seq, target_id, what, wanted FROM conds")
def preconditions(spark, sf):
    return A.preconditions(_ops(spark, sf), _nodes(spark, sf))


@query(f"""{_CONDITIONS}, {_AFTER}, later AS ({_NEAR.format(t="after")}), heads AS ({_FIRST.format(near="later")})
    SELECT op_id, op_seq, target_id, what, block_id IS NOT NULL AND wanted IS NOT DISTINCT FROM CASE what WHEN 'exists' THEN 'true' WHEN 'hash' THEN hash WHEN 'parent' THEN l.parent_id WHEN 'first' THEN coalesce(first, '') ELSE coalesce(following, '') END AS holds FROM conds LEFT JOIN later l ON block_id = target_id LEFT JOIN heads h ON h.parent_id = target_id""")
def check_preconditions(spark, sf):
    nodes = _nodes(spark, sf)
    return A.check_preconditions(A.preconditions(_ops(spark, sf), nodes), _after(nodes))


@query(f"""{_LOG}, numbered AS (SELECT batch, op_seq, op_id, sha256(concat_ws('|', CAST(op_seq AS VARCHAR), kind, target_id, coalesce(expected_hash, ''))) AS t, (row_number() OVER (PARTITION BY batch ORDER BY op_seq, op_id) - 1) // 4096 AS stretch FROM ops),
    parts AS (SELECT batch, stretch, sha256(string_agg(t, ',' ORDER BY op_seq, op_id)) AS h, count(*) AS n FROM numbered GROUP BY 1, 2) SELECT batch, sha256(string_agg(h, ',' ORDER BY stretch)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n_ops FROM parts GROUP BY batch""")
def op_tokens(spark, sf):
    return A.op_tokens(_ops(spark, sf), "batch")


@query(f"{_LOG}, {_AFTER}, allowed AS (SELECT DISTINCT target_id AS block_id FROM ops WHERE target_id <> 'root' UNION SELECT e.block_id FROM (SELECT block_id, parent_id FROM nodes UNION SELECT block_id, parent_id FROM after) e JOIN allowed a ON e.parent_id = a.block_id), c AS (SELECT coalesce(n.block_id, a.block_id) AS block_id, CASE WHEN n.block_id IS NULL THEN 'added' WHEN a.block_id IS NULL THEN 'removed' ELSE 'updated' END AS change FROM nodes n FULL JOIN after a ON n.block_id = a.block_id WHERE n.hash IS DISTINCT FROM a.hash) SELECT * FROM c WHERE block_id NOT IN (SELECT block_id FROM allowed)")
def unplanned_changes(spark, sf):
    nodes = _nodes(spark, sf)
    return A.unplanned_changes(nodes.select("block_id", "parent_id", "hash"), _after(nodes).drop("pos"), _ops(spark, sf).filter("target_id <> 'root'"))


@query(f"{_LOG}, {_AFTER}, later AS ({_NEAR.format(t='after')}) SELECT op_id, op_seq, CASE WHEN kind = 'delete' THEN block_id IS NULL WHEN kind = 'replace' THEN block_id IS NOT NULL ELSE block_id IS NOT NULL AND coalesce(previous, l.parent_id) IS NOT DISTINCT FROM after_id END AS done FROM ops LEFT JOIN later l ON block_id = target_id")
def check_readback(spark, sf):
    return A.check_readback(_ops(spark, sf), _after(_nodes(spark, sf)))


@query(f"{_LOG}, r AS (SELECT batch, op_seq, (batch LIKE '%3' OR op_seq % 1000 < 300 OR (batch > 'b5' AND op_seq < 1500)) AND op_id <> 'dup' AS ran FROM ops), s AS (SELECT batch, count(*) FILTER (WHERE NOT ran) AS pending, min(op_seq) FILTER (WHERE NOT ran) AS f, max(op_seq) FILTER (WHERE ran) AS l FROM r GROUP BY batch) , t AS (SELECT batch, pending, CASE WHEN CAST(substr(batch, 2) AS BIGINT) % 8 = 1 THEN 'document-changed' WHEN pending = 0 THEN 'complete' WHEN coalesce(l < f, true) THEN 'prefix' ELSE 'out-of-order' END AS why FROM s) SELECT batch, pending, CASE why WHEN 'complete' THEN 'done' WHEN 'prefix' THEN 'resume' ELSE 'manual' END AS state, why FROM t")
def resume_report(spark, sf):
    ops = _ops(spark, sf)
    ran = ops.filter("(batch LIKE '%3' OR op_seq % 1000 < 300 OR (batch > 'b5' AND op_seq < 1500)) AND op_id <> 'dup'").select("op_id")
    number = F.substring("batch", 2, 20).cast("long")
    states = ops.select("batch").distinct().select("batch", F.when(number % 8 != 5, "h").alias("recorded"), F.when(number % 4 == 1, "other").otherwise("h").alias("current"))
    return A.resume_report(ops, ran, states)


@query(f"{_LOG}, p AS (SELECT batch, op_id, op_seq, CAST(unnest(CASE kind WHEN 'replace' THEN [1, 4] WHEN 'move' THEN [2] WHEN 'insert' THEN [3] ELSE [5] END) AS INTEGER) AS phase FROM ops) SELECT batch, op_id, phase, row_number() OVER (PARTITION BY batch ORDER BY phase, op_seq, op_id) - 1 AS position FROM p")
def phase_order(spark, sf):
    return A.phase_order(_ops(spark, sf), {"replace": [1, 4], "move": [2], "insert": [3], "delete": [5]})


@query(f"{_J}, f AS (SELECT batch, op_seq, op_id, target_id FROM j WHERE NOT found) SELECT batch, min(op_seq) AS op_seq, min_by(op_id, op_seq) AS op_id, min_by(target_id, op_seq) AS target_id FROM f GROUP BY batch")
def first_blocker(spark, sf):
    ops = _ops(spark, sf)
    missing = ops.join(_nodes(spark, sf).select(F.col("block_id").alias("target_id")), "target_id", "left_anti")
    return A.first_blocker(missing, ["batch"], ["op_seq", "op_id", "target_id"])


@query(f"{_LOG} SELECT batch, bool_and(op_seq % 37 <> 0) AS safe, bool_or(op_seq % 5 = 0) AS risky, bool_or(op_seq % 11 = 0) AS needs_confirmation FROM ops GROUP BY batch")
def plan_flags(spark, sf):
    ops = _ops(spark, sf).withColumns({"blocked": F.col("op_seq") % 37 == 0, "remote_changed": F.col("op_seq") % 5 == 0, "tracked": F.col("op_seq") % 11 != 0})
    return A.plan_flags(ops, "batch")


@query("WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS copy FROM orders), d AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT o_orderkey, r.o_custkey FROM r LEFT JOIN d ON d.o_custkey = r.o_custkey WHERE copy > coalesce(n, 0)")
def surplus_copies(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return A.surplus_copies(orders, orders.filter("o_orderkey % 3 = 0"), ["o_custkey"], "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)")
def missing_tracked(spark, sf):
    return A.missing_tracked(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").filter("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT conv_id, sha256(string_agg(sha256(text), ',' ORDER BY turn, sha256(text))) AS hash FROM conversations WHERE NOT (role = 'user' AND conv_id % 3 = 0) GROUP BY conv_id")
def outside_hash(spark, sf):
    nodes = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.sha2("text", 256).alias("h"))
    return A.outside_hash(nodes, nodes.filter("role = 'user' AND conv_id % 3 = 0"), "conv_id", "role", "turn", "h")


@query("""WITH d AS (SELECT o_custkey AS k, o_orderkey AS pos, o_orderpriority || o_orderkey % 200 AS v FROM orders WHERE o_orderkey % 7 <> 1), r AS (SELECT o_custkey AS k, o_orderkey AS pos, o_orderpriority || o_orderkey % 200 AS v, 'r' || o_orderkey AS remote_id FROM orders WHERE o_orderkey % 5 <> 2),
    e AS (SELECT k, pos, remote_id FROM d JOIN r USING (k, pos)), rd AS (SELECT * FROM d ANTI JOIN e USING (k, pos)), rr AS (SELECT * FROM r ANTI JOIN e USING (remote_id)),
    u AS (SELECT rd.k, rd.pos, rr.remote_id FROM rd JOIN rr USING (v) WHERE v IN (SELECT v FROM rd GROUP BY v HAVING count(*) = 1) AND v IN (SELECT v FROM rr GROUP BY v HAVING count(*) = 1))
    SELECT d.k, d.pos, coalesce(e.remote_id, u.remote_id) AS remote_id, CASE WHEN e.remote_id IS NOT NULL THEN 'locator' WHEN u.remote_id IS NOT NULL THEN 'unique' ELSE 'create' END AS how FROM d LEFT JOIN e USING (k, pos) LEFT JOIN u USING (k, pos)""")
def assign_once(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos"), F.concat("o_orderpriority", (F.col("o_orderkey") % 200).cast("string")).alias("v"))
    rows = materialize(rows, "assign")
    return A.assign_once(rows.filter("pos % 7 <> 1"), rows.filter("pos % 5 <> 2").withColumn("remote_id", F.concat(F.lit("r"), F.col("pos").cast("string"))), ["k", "pos"], "v").select("k", "pos", "remote_id", "how")
