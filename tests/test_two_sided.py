from textloom.operators import compare as C


def test_two_sided_changes_meet_once(spark):
    side = lambda *rows: spark.createDataFrame(list(rows), "g int, k int, v string")
    base = side((1, 1, "a"), (1, 2, None), (1, 3, "c"), (1, 4, "d"), (2, 1, "x"), (3, 1, "p"), (3, 1, "q"))
    local = side((1, 1, "a"), (1, 2, None), (1, 3, "C"), (1, 5, "n"), (2, 1, "x"), (3, 1, "p"), (3, 1, "q"))
    remote = side((1, 1, "A"), (1, 2, ""), (1, 3, "C"), (1, 4, "d"), (1, 6, None), (2, 1, "x"))
    met = C.two_sided_changes(base, local, remote, ["g", "k"], "v")
    want = {(1, 1, False, True), (1, 2, False, True), (1, 3, True, True), (1, 4, True, False), (1, 5, True, False), (1, 6, False, True), (2, 1, False, False), (3, 1, True, True)}
    assert set(map(tuple, met.collect())) == want
    joined = {tuple(r) for df, i in ((local, 2), (remote, 3)) for r in C.changed_nodes(base, df, ["g", "k"], "v").selectExpr("g", "k", f"{i} AS i").collect()}
    assert joined == {(g, k, i) for g, k, *sides in want for i, changed in zip((2, 3), sides) if changed}
    assert {tuple(r) for r in C.unrelated_changes(base, local, remote, ["g", "k"], "v").collect()} == {(1, 1), (1, 2), (1, 6)}
    assert {tuple(r) for r in C.scope_summary(base, local, remote, ["g"], "k", "v").collect()} == {(1, 3, 4, 1, 3), (3, 1, 1, 1, 0)}
    assert met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1
