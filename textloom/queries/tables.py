"""Keyed tables: diff, correspondence, merge."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from textloom.operators import tables as B
from textloom.queries import query
from textloom.runtime import materialize, scratch, table
from textloom.sources import derived as D

CELLS = ["c1", "c2", "c3"]
_TBL = D.with_ctes("tbl_cur", "tbl_remote")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, 'duplicate' AS issue FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def key_issues(spark, sf):
    return B.key_issues(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_J = f"{_TBL}, j AS (SELECT coalesce(b.table_key, c.table_key) AS table_key, coalesce(b.row_key, c.row_key) AS row_key, b.row_key AS x, c.row_key AS y, b.c1 IS DISTINCT FROM c.c1 AS d1, b.c2 IS DISTINCT FROM c.c2 AS d2, b.c3 IS DISTINCT FROM c.c3 AS d3 FROM tbl_base b FULL JOIN tbl_cur c ON b.table_key = c.table_key AND b.row_key = c.row_key)"


@query(f"{_J} SELECT table_key, row_key, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'deleted' ELSE 'updated' END AS change, CASE WHEN x IS NULL OR y IS NULL THEN '' ELSE concat_ws(',', CASE WHEN d1 THEN 'c1' END, CASE WHEN d2 THEN 'c2' END, CASE WHEN d3 THEN 'c3' END) END AS cells, y IS NULL AS blocker FROM j WHERE d1 OR d2 OR d3 OR x IS NULL OR y IS NULL")
def table_diff(spark, sf):
    base, cur, _ = D.tables(spark, sf)
    return B.table_diff(base, cur, CELLS)


_MATCH = f"""{_TBL}, a AS (SELECT *, row_number() OVER w - 1 AS at, count(*) OVER (PARTITION BY table_key) AS n FROM tbl_base WINDOW w AS (PARTITION BY table_key ORDER BY row_key)), b AS (SELECT *, row_number() OVER w - 1 AS at, count(*) OVER (PARTITION BY table_key) AS n FROM tbl_cur WINDOW w AS (PARTITION BY table_key ORDER BY row_key)),
    e AS (SELECT a.table_key, a.row_key FROM a JOIN b ON a.table_key = b.table_key AND a.row_key = b.row_key),
    la AS (SELECT *, count(*) OVER (PARTITION BY table_key) AS m FROM a ANTI JOIN e USING (table_key, row_key)), lb AS (SELECT *, count(*) OVER (PARTITION BY table_key) AS m FROM b ANTI JOIN e USING (table_key, row_key)),
    matched AS (SELECT table_key, row_key AS base_row, row_key AS current_row, 'key' AS how FROM e UNION ALL SELECT la.table_key, la.row_key, lb.row_key, 'rename' FROM la JOIN lb ON la.table_key = lb.table_key WHERE la.m = 1 AND lb.m = 1 AND la.n = lb.n AND la.at = lb.at AND (la.c1 = lb.c1 OR la.c2 = lb.c2 OR la.c3 = lb.c3))"""


#: Every input once: the windows and anti joins read the changed copies several times.
_MATCH = re.sub(r"\b(\w+) AS \((?=SELECT)", r"\1 AS MATERIALIZED (", _MATCH)


@query(f"{_MATCH} SELECT * FROM matched")
def match_rows(spark, sf):
    base, cur, _ = D.tables(spark, sf)
    return B.match_rows(base, cur, CELLS)


@query(f"""{_MATCH}, old AS (SELECT table_key, coalesce(current_row, row_key) AS row_key, c1, c2, c3, current_row IS NOT NULL AS moved FROM tbl_base LEFT JOIN (SELECT table_key, base_row AS row_key, current_row FROM matched WHERE how = 'rename') USING (table_key, row_key)),
    d AS (SELECT table_key, row_key, old.c1 IS NULL AS new, c.c1 IS NULL AS gone, concat_ws(',', CASE WHEN moved THEN 'row_key' END, CASE WHEN old.c1 <> c.c1 THEN 'c1' END, CASE WHEN old.c2 <> c.c2 THEN 'c2' END, CASE WHEN old.c3 <> c.c3 THEN 'c3' END) AS names FROM old FULL JOIN tbl_cur c USING (table_key, row_key))
    SELECT table_key, row_key, CASE WHEN new THEN 'added' WHEN gone THEN 'deleted' ELSE 'updated' END AS change, CASE WHEN new OR gone THEN '' ELSE names END AS cells, gone AS blocker FROM d WHERE new OR gone OR names <> ''""")
def table_diff_renames(spark, sf):
    base, cur, _ = D.tables(spark, sf)
    return B.table_diff(base, cur, CELLS, allow_rename=True)


#: Source rows of which some tables have another order, an empty key or one twice; headers of which some differ.
_SOURCE_ROWS = "SELECT table_key, CASE WHEN table_key % 15 = 4 AND row_key = 2 THEN '' WHEN table_key % 15 = 8 AND row_key = 3 THEN '2' ELSE CAST(row_key AS VARCHAR(20)) END AS row_key, CASE WHEN table_key % 12 = 5 THEN -row_key ELSE row_key END AS pos FROM tbl_cur"
_HEADS = "SELECT DISTINCT table_key, CASE WHEN table_key % 9 = {a} THEN 'k,c1,other,c3' WHEN table_key % 9 = {b} THEN 'k,c1,c2' ELSE 'k,c1,c2,c3' END AS headers FROM {t}"


@query(f"""{_TBL}, rh AS ({_HEADS.format(a=2, b=4, t="tbl_base")}), sh AS ({_HEADS.format(a=2, b=5, t="tbl_cur")}), hh AS (SELECT table_key, rh.headers AS h1, sh.headers AS h2 FROM rh JOIN sh USING (table_key)),
    r AS (SELECT table_key, CAST(row_key AS VARCHAR) AS row_key, row_key AS pos FROM tbl_base WHERE table_key IN (SELECT table_key FROM hh)), s AS (SELECT * FROM ({_SOURCE_ROWS}) WHERE table_key IN (SELECT table_key FROM hh)),
    i AS (SELECT table_key, row_key, CASE WHEN row_key = '' THEN 'source-empty-key' ELSE 'source-duplicate-key' END AS blocker FROM s GROUP BY 1, 2 HAVING row_key = '' OR count(*) > 1), d AS (SELECT table_key, row_key FROM r ANTI JOIN s USING (table_key, row_key)),
    p AS (SELECT table_key, r.pos AS a, s.pos AS b FROM r JOIN s USING (table_key, row_key) WHERE table_key NOT IN (SELECT table_key FROM i UNION SELECT table_key FROM d)), o AS (SELECT table_key FROM (SELECT table_key, b < lag(b) OVER (PARTITION BY table_key ORDER BY a) AS turned FROM p) WHERE turned)
    SELECT table_key, 'headers-differ' AS blocker, CAST(NULL AS VARCHAR) AS row_key FROM hh WHERE h1 <> h2 UNION ALL SELECT table_key, blocker, row_key FROM i UNION ALL SELECT table_key, 'deletes-row', row_key FROM d UNION ALL SELECT DISTINCT table_key, 'reorders-rows', NULL FROM o""")
def table_blockers(spark, sf):
    base, cur, _ = D.tables(spark, sf)
    rows = spark.sql(_SOURCE_ROWS.replace("FROM tbl_cur", "FROM {t}"), t=cur)
    heads = [spark.sql(_HEADS.format(a=2, b=b, t="{t}"), t=df).withColumn("headers", F.split("headers", ",")) for b, df in ((4, base), (5, cur))]
    return B.table_blockers(base.select("table_key", "row_key", F.col("row_key").alias("pos")), rows, *heads)


@query(f"""{_TBL}, j AS (SELECT coalesce(b.table_key, c.table_key, r.table_key) AS table_key, coalesce(b.row_key, c.row_key, r.row_key) AS row_key, b.c1 AS b1, c.c1 AS l1, r.c1 AS r1, b.c3 AS b3, c.c3 AS l3, r.c3 AS r3
    FROM tbl_base b FULL JOIN tbl_cur c ON b.table_key = c.table_key AND b.row_key = c.row_key FULL JOIN tbl_remote r ON r.table_key = coalesce(b.table_key, c.table_key) AND r.row_key = coalesce(b.row_key, c.row_key))
    SELECT table_key, row_key, CASE WHEN b1 IS DISTINCT FROM l1 THEN l1 ELSE r1 END AS c1, b1 IS DISTINCT FROM l1 AND b1 IS DISTINCT FROM r1 AND l1 IS DISTINCT FROM r1 AS c1_conflict, CASE WHEN b3 IS DISTINCT FROM l3 THEN l3 ELSE r3 END AS c3, b3 IS DISTINCT FROM l3 AND b3 IS DISTINCT FROM r3 AND l3 IS DISTINCT FROM r3 AS c3_conflict FROM j""")
def merge_field(spark, sf):
    base, cur, remote = (df.select(*B.KEYS, *(F.col(c).alias(f"{n}_{c}") for c in ("c1", "c3"))) for df, n in zip(D.tables(spark, sf), ("b", "l", "r")))
    j = base.join(cur, B.KEYS, "full_outer").join(remote, B.KEYS, "full_outer")
    merged = {c: B.merge_field(F.col(f"b_{c}"), F.col(f"l_{c}"), F.col(f"b_{c}"), F.col(f"r_{c}")) for c in ("c1", "c3")}
    return j.select(*B.KEYS, *(col for c, (v, x) in merged.items() for col in (v.alias(c), x.alias(f"{c}_conflict"))))


@query(f"""{_TBL}, j AS (SELECT coalesce(b.table_key, c.table_key, r.table_key) AS table_key, coalesce(b.row_key, c.row_key, r.row_key) AS row_key, b.row_key AS hb, c.row_key AS hl, r.row_key AS hr, b.c1 AS b1, c.c1 AS l1, r.c1 AS r1, b.c2 AS b2, c.c2 AS l2, r.c2 AS r2, b.c3 AS b3, c.c3 AS l3, r.c3 AS r3
    FROM tbl_base b FULL JOIN tbl_cur c ON b.table_key = c.table_key AND b.row_key = c.row_key FULL JOIN tbl_remote r ON r.table_key = coalesce(b.table_key, c.table_key) AND r.row_key = coalesce(b.row_key, c.row_key)),
    s AS (SELECT *, CASE WHEN hb IS NULL AND hl IS NOT NULL THEN CASE WHEN hr IS NOT NULL THEN 'collision' ELSE 'added' END WHEN hb IS NOT NULL AND hl IS NULL THEN CASE WHEN hr IS NOT NULL THEN 'deleted' END
        WHEN hb IS NOT NULL AND hl IS NOT NULL AND (b1 IS DISTINCT FROM l1 OR b2 IS DISTINCT FROM l2 OR b3 IS DISTINCT FROM l3) THEN CASE WHEN hr IS NOT NULL THEN 'updated' ELSE 'missing' END WHEN hr IS NOT NULL THEN 'kept' END AS state FROM j)
    SELECT table_key, row_key, state, CASE WHEN state = 'added' OR (state = 'updated' AND b1 IS DISTINCT FROM l1) THEN l1 ELSE r1 END AS c1, CASE WHEN state = 'added' OR (state = 'updated' AND b2 IS DISTINCT FROM l2) THEN l2 ELSE r2 END AS c2, CASE WHEN state = 'added' OR (state = 'updated' AND b3 IS DISTINCT FROM l3) THEN l3 ELSE r3 END AS c3 FROM s WHERE state IS NOT NULL""")
def table_merge(spark, sf):
    base, cur, remote = D.tables(spark, sf)
    return B.table_merge(base, cur, base, remote, CELLS)


@query(f"""{_TBL}, l AS (SELECT table_key, row_key, row_number() OVER (PARTITION BY table_key ORDER BY row_key) - 1 AS al FROM tbl_cur), r AS (SELECT table_key, row_key, row_number() OVER (PARTITION BY table_key ORDER BY row_key) - 1 AS ar FROM tbl_remote),
    j AS (SELECT coalesce(l.table_key, r.table_key) AS table_key, coalesce(l.row_key, r.row_key) AS row_key, al, ar FROM l FULL JOIN r ON l.table_key = r.table_key AND l.row_key = r.row_key),
    k AS (SELECT j.*, coalesce(ar, (SELECT max_by(x.ar, x.al) FROM j x WHERE x.table_key = j.table_key AND x.al < j.al AND x.ar IS NOT NULL), -1) AS anchor FROM j)
    SELECT table_key, row_key, ar IS NULL AS "new", row_number() OVER (PARTITION BY table_key ORDER BY anchor, ar IS NULL, al NULLS FIRST) - 1 AS pos FROM k""")
def insertion_order(spark, sf):
    _, cur, remote = D.tables(spark, sf)
    return B.insertion_order(cur, remote)


@query(f"{_TBL} SELECT table_key, sha256(string_agg(row_key || '|' || c3, ';' ORDER BY row_key)) AS identity, count(*) AS rows FROM tbl_cur GROUP BY table_key")
def table_identity(spark, sf):
    return B.table_identity(D.tables(spark, sf)[1], ["row_key", "c3"])


@query(f"{_TBL}, f AS (SELECT DISTINCT a.table_key AS s, b.table_key AS r FROM tbl_base a JOIN tbl_cur b ON a.table_key % 1000 = b.table_key % 1000 AND a.table_key // 3000 = b.table_key // 3000 AND a.row_key = b.row_key), n AS (SELECT s, count(*) AS n FROM f GROUP BY s) SELECT DISTINCT table_key, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS state FROM tbl_base LEFT JOIN n ON s = table_key")
def match_tables(spark, sf):
    name = F.concat_ws(":", (F.col("table_key") % 1000).cast("string"), F.floor(F.col("table_key") / 3000).cast("string"))
    with scratch(spark):
        base, cur, _ = D.tables(spark, sf)
        return materialize(B.match_tables(base.withColumn("identity", name), cur.withColumn("identity", name), "identity"), "matched-tables", keep=True)


@query(f"{_TBL} SELECT c.table_key, c.row_key, CASE WHEN lower(c.c3) = lower(r.c3) THEN lower(r.c3) ELSE c.c3 END AS c3 FROM tbl_cur c LEFT JOIN tbl_remote r ON c.table_key = r.table_key AND c.row_key = r.row_key")
def preserve_cells(spark, sf):
    _, cur, remote = D.tables(spark, sf)
    return B.preserve_cells(cur, remote.withColumn("c3", F.lower("c3")), ["c3"], lambda a, b: F.lower(a) == F.lower(b))
