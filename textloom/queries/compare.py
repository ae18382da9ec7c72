"""Versions compared by key, by value and by position."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import compare as C
from textloom.operators import lines as L
from textloom.operators import tables as B
from textloom.queries import query
from textloom.runtime import table
from textloom.sources import derived as D

_TBL = D.with_ctes("tbl_cur", "tbl_remote")
_FOUR = D.with_ctes("four")
_ROWH = "sha256(concat_ws('|', CAST(CAST(c1 AS BIGINT) AS VARCHAR), CAST(CAST(round(c2 * 100) AS BIGINT) AS VARCHAR), c3))"


def _said(df):
    """Rows as short texts: where only their equality counts, these shuffle instead of their hashes."""
    return df.select(*B.KEYS, F.concat_ws("|", F.col("c1").cast("long").cast("string"), F.round(F.col("c2") * 100).cast("long").cast("string"), "c3").alias("said"))


def _hashed(df):
    return _said(df).select(*B.KEYS, F.sha2("said", 256).alias("hash"))


_CHANGES = f"""{_TBL}, b AS (SELECT table_key, row_key, {_ROWH} AS hash FROM tbl_base), c AS (SELECT table_key, row_key, {_ROWH} AS hash FROM tbl_cur), r AS (SELECT table_key, row_key, {_ROWH} AS hash FROM tbl_remote),
    lc AS (SELECT table_key, row_key, b.hash AS before, c.hash AS after, CASE WHEN b.hash IS NULL THEN 'added' WHEN c.hash IS NULL THEN 'removed' ELSE 'updated' END AS change FROM b FULL JOIN c USING (table_key, row_key) WHERE b.hash IS DISTINCT FROM c.hash),
    rc AS (SELECT table_key, row_key FROM b FULL JOIN r USING (table_key, row_key) WHERE b.hash IS DISTINCT FROM r.hash)"""


@query(f"{_CHANGES} SELECT * FROM lc")
def changed_nodes(spark, sf):
    base, cur, _ = (_hashed(t) for t in D.tables(spark, sf))
    return C.changed_nodes(base, cur, B.KEYS)


@query(f"{_CHANGES} SELECT table_key, row_key FROM b UNION SELECT table_key, row_key FROM c")
def all_keys(spark, sf):
    base, cur, _ = D.tables(spark, sf)
    return C.all_keys(base, cur, B.KEYS)


@query(f"{_CHANGES} SELECT table_key, row_key FROM b INTERSECT SELECT table_key, row_key FROM c")
def shared_keys(spark, sf):
    base, cur, _ = D.tables(spark, sf)
    return C.shared_keys(base, cur, B.KEYS)


@query(f"{_CHANGES} SELECT table_key, row_key FROM rc EXCEPT SELECT table_key, row_key FROM lc")
def unrelated_changes(spark, sf):
    return C.unrelated_changes(*map(_said, D.tables(spark, sf)), B.KEYS, "said")


@query(f"{_CHANGES}, j AS (SELECT coalesce(lc.table_key, rc.table_key) AS table_key, lc.row_key AS l, rc.row_key AS r FROM lc FULL JOIN rc ON lc.table_key = rc.table_key AND lc.row_key = rc.row_key) SELECT table_key, count(l) AS local_changed, count(r) AS remote_changed, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS overlapping, count(*) FILTER (WHERE l IS NULL) AS unrelated FROM j GROUP BY table_key")
def scope_summary(spark, sf):
    return C.scope_summary(*map(_said, D.tables(spark, sf)), ["table_key"], "row_key", "said")


@query(f"{_CHANGES} SELECT table_key % 100 AS bucket, count(*) FILTER (WHERE c.hash = r.hash) AS matching, count(*) FILTER (WHERE c.hash <> r.hash) AS changed, count(*) FILTER (WHERE r.hash IS NULL) AS local_only, count(*) FILTER (WHERE c.hash IS NULL) AS remote_only FROM c FULL JOIN r USING (table_key, row_key) GROUP BY table_key % 100")
def divergence(spark, sf):
    _, cur, remote = (_hashed(t) for t in D.tables(spark, sf))
    return C.divergence(cur, remote, B.KEYS, "hash", [(F.col("table_key") % 100).alias("bucket")])


@query(f"""{_FOUR}, a AS (SELECT doc_id, unnest(range(len(x))) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(l1, chr(10)) AS x FROM four)), b AS (SELECT doc_id, unnest(range(len(x))) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(r1, chr(10)) AS x FROM four)),
    j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.line_no, b.line_no) AS line_no, a.line AS x, b.line AS y FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.line_no = b.line_no)
    SELECT doc_id, line_no, ' ' AS mark, x AS line FROM j WHERE x = y UNION ALL SELECT doc_id, line_no, '-', x FROM j WHERE x IS NOT NULL AND x IS DISTINCT FROM y UNION ALL SELECT doc_id, line_no, '+', y FROM j WHERE y IS NOT NULL AND x IS DISTINCT FROM y""")
def positional_diff(spark, sf):
    four = D.four_way(spark, sf)
    return C.positional_diff(*(L.explode_lines(four.select("doc_id", F.col(c).alias("text"))) for c in ("l1", "r1")))


_TWO = f"""{_FOUR}, a AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(l0, chr(10)) AS x FROM four)), b AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(l1, chr(10)) AS x FROM four)),
    n AS (SELECT doc_id, count(*) AS n FROM a GROUP BY doc_id), j AS (SELECT a.doc_id, a.pos, a.line IS DISTINCT FROM b.line AS differs FROM a JOIN b USING (doc_id, pos)),
    p AS (SELECT doc_id, n, coalesce(min(pos) FILTER (WHERE differs), n) AS prefix, coalesce(n - 1 - max(pos) FILTER (WHERE differs), n) AS tail FROM j JOIN n USING (doc_id) GROUP BY doc_id, n)"""


def _two(spark, sf):
    four = D.four_way(spark, sf)
    return tuple(L.explode_lines(four.select("doc_id", F.col(c).alias("text"))).withColumnRenamed("line_no", "pos") for c in ("l0", "l1"))


@query(f"{_TWO} SELECT doc_id, prefix FROM p")
def common_prefix(spark, sf):
    return C.common_prefix(*_two(spark, sf), ["doc_id"], "line", "pos")


@query(f"{_TWO} SELECT doc_id, prefix, least(tail, n - prefix) AS suffix FROM p")
def common_suffix(spark, sf):
    return C.common_suffix(*_two(spark, sf), ["doc_id"], "line", "pos")


@query(f"""{_FOUR}, a AS (SELECT doc_id, unnest(range(len(x))) AS k, unnest(x) AS v FROM (SELECT doc_id, string_split(l0, chr(10)) AS x FROM four)), b AS (SELECT doc_id, unnest(range(len(x))) AS k, unnest(x) AS v FROM (SELECT doc_id, string_split(l1, chr(10)) AS x FROM four)),
    ca AS (SELECT *, count(*) OVER (PARTITION BY doc_id, v) AS n FROM a), cb AS (SELECT *, count(*) OVER (PARTITION BY doc_id, v) AS n FROM b),
    f AS (SELECT ca.doc_id, ca.k AS base_key, cb.k AS current_key FROM ca JOIN cb ON ca.doc_id = cb.doc_id AND ca.v = cb.v WHERE ca.n = 1 AND cb.n = 1)
    SELECT doc_id, base_key, current_key, 'value' AS how FROM f UNION ALL
    SELECT ca.doc_id, ca.k, cb.k, CASE WHEN EXISTS (SELECT 1 FROM cb x WHERE x.doc_id = ca.doc_id AND x.v = ca.v AND x.n <> ca.n) THEN 'ambiguous' ELSE 'key' END FROM ca JOIN cb ON ca.doc_id = cb.doc_id AND ca.k = cb.k
    WHERE (ca.doc_id, ca.k) NOT IN (SELECT (doc_id, base_key) FROM f) AND (cb.doc_id, cb.k) NOT IN (SELECT (doc_id, current_key) FROM f)""")
def correspond_nodes(spark, sf):
    a, b = (df.withColumnRenamed("pos", "k").withColumnRenamed("line", "v") for df in _two(spark, sf))
    return C.correspond_nodes(a, b, ["doc_id"], "k", "v")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def first_wins(spark, sf):
    return C.first_wins(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id", "event_type"], ["event_id"])


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS occ FROM events")
def occurrence(spark, sf):
    return C.occurrence(table(spark, sf, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_id", "occ")


@query("SELECT user_id, bool_and(coalesce(v > before, true)) AS preserved FROM (SELECT user_id, event_id % 7 + event_id AS v, lag(event_id % 7 + event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY user_id")
def order_preserved(spark, sf):
    pairs = table(spark, sf, "events").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") % 7 + F.col("event_id")).alias("b"))
    return C.order_preserved(pairs, ["user_id"], "a", "b")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role <> 'system' THEN sha256(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
    first_value(CASE WHEN role <> 'system' THEN sha256(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM conversations""")
def neighbour_hash(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.sha2("text", 256).alias("h"))
    return C.neighbours(rows, ["conv_id"], "turn", "h", F.col("role") == "system").select("conv_id", "turn", "previous", "following")


@query("""SELECT conv_id, turn, sha256(role || '|' || coalesce(lag(sha256(text)) OVER (PARTITION BY conv_id, role ORDER BY turn), '^')) AS placement FROM conversations""")
def placement_key(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.sha2("text", 256).alias("h"))
    return C.placement_key(rows, ["conv_id"], "role", "turn", "h").select("conv_id", "turn", "placement")
