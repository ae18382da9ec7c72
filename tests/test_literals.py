"""Small literal cases with known results."""

import pytest
from pyspark.sql import functions as F
from textloom.functions import text as T
from textloom.operators import compare as C
from textloom.operators import extract as E
from textloom.operators import lines as L
from textloom.operators import links as K
from textloom.operators import merge as M
from textloom.operators import tables as B
from textloom.plans import nodes as P
from textloom.sources import corpus as S
from textloom.streaming import feeds


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("value,want", [("a \r\n\r\n\r\n\r\nb\t \n", "a\n\nb"), ("  x", "x"), ("", ""), (None, None), ("a\n \n \nb", "a\n\nb")])
def test_canonical_markdown(spark, value, want):
    assert one(spark, value, T.canonical_markdown) == want


@pytest.mark.parametrize("value,want", [("12) x", "1. x"), ("  3. y", "  1. y"), ("|a|:--:|", "|a|:--:|"), ("|:-|-:|---|", "| :--- | ---: | --- |"), ("a\u00a0b", "a b"), ("3.x", "3.x")])
def test_canonical_line(spark, value, want):
    assert one(spark, value, T.canonical_line) == want


@pytest.mark.parametrize("value,want", [("../a/b.md#x", "b"), ("a/index.md?q", "a"), ("x%20y.mdx", "x y"), ("#top", None), ("index.md", None), ("a\\b.md", "b"), ("%zz", None), ("a+b.md", "a+b")])
def test_link_slug(spark, value, want):
    assert one(spark, value, T.link_slug) == want


@pytest.mark.parametrize("value,want", [("./a/../b//c.png", "b/c.png"), ("..\\x/./y", "../x/y"), ("/a/../../b", "/../b"), ("a/..", "")])
def test_asset_key(spark, value, want):
    assert one(spark, value, T.asset_key) == want


@pytest.mark.parametrize("value,want", [("https://x.example.com/docx/AB12/?a=1#b", ("docx", "AB12")), ("ABCDEFGHIJKLMNOP", ("docx", "ABCDEFGHIJKLMNOP")), ("short", None), ("https://x/wiki/W1", ("wiki", "W1"))])
def test_parse_target(spark, value, want):
    got = one(spark, value, lambda c: T.parse_target(c, {"docx": "docx", "wiki": "wiki"}))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "value,want",
    [
        ('a<include target="x">1</include>b<exclude target="x">2</exclude>c', "a1bc"),
        ('<include target="y">1</include>|<exclude target="y">2</exclude>', "|2"),
        ('<include>1</include><include target="zz">2</include>', '<include>1</include><include target="zz">2</include>'),
        ('<include target="x, y">1</include>', "1"),
    ],
)
def test_filter_profile(spark, value, want):
    assert one(spark, value, lambda c: T.filter_profile(c, "x", ["x", "y"])) == want


def test_revision_reached(spark):
    df = spark.createDataFrame([("10", "9"), ("9", "10"), ("a", "a"), ("10", "a"), ("99999999999999999999999", "1")], "a string, b string")
    assert [r.r for r in df.select(T.revision_reached(F.col("a"), F.col("b")).alias("r")).collect()] == [True, False, True, False, True]


def test_fences(spark):
    text = "```py\na\n~~~\n````\nb\n~~~~ x\n```\n~~~\nc"
    got = sorted(tuple(r)[1:] for r in L.fence_ranges(docs(spark, text)).collect())
    assert got == [(0, 3, True), (5, 8, False)]
    strict = sorted(tuple(r)[1:] for r in L.fence_ranges(docs(spark, "```\na\n``` x\n```"), strict_close=True).collect())
    assert strict == [(0, 3, True)]


def test_sections_drop_deeper_titles_and_leave_no_holes(spark):
    b = L.section_path(L.extract_blocks(docs(spark, "# A\n\n### C\n\nx\n\n## B\n\ny\n\n# D\n\nz")))
    got = {r.text: list(r.section) for r in b.collect()}
    assert got["x"] == ["a", "c"] and got["y"] == ["a", "b"] and got["z"] == ["d"] and got["B"] == ["a", "b"]


def test_code_issues(spark):
    got = {r.first: (r.language, r.content, list(r.issues)) for r in E.extract_code(docs(spark, "```Py title\nx\n```\n\n~~~~\n```\ny")).collect()}
    assert got == {0: ("py", "x", ["info-string"]), 4: ("", "```\ny", ["unclosed", "nested"])}


def test_pipe_cells_keep_escaped_pipes_and_code(spark):
    assert one(spark, r"| a \| b | `x|y` | c |", E.pipe_cells) == ["a | b", "`x|y`", "c"]


def test_inline_runs(spark):
    df = spark.createDataFrame([("a **b** `c` [d](https%3A%2F%2Fe) *f* ==g==",)], "line string")
    got = [(r.kind, r.value, r.url) for r in E.inline_runs(df).orderBy("pos").collect()]
    assert got == [("text", "a ", None), ("bold", "b", None), ("text", " ", None), ("code", "c", None), ("text", " ", None), ("link", "d", "https://e"), ("text", " ", None), ("italic", "f", None), ("text", " ", None), ("highlight", "g", None)]


def test_admonition_blockers(spark):
    got = [(r.first, r.last, r.type, r.title, r.content, r.blocker) for r in E.admonitions(docs(spark, ":::note T\nx\n:::\n:::tip\n:::note\ny\n:::\n:::tip\nz")).orderBy("first").collect()]
    assert got == [(0, 2, "note", "T", "x", None), (3, None, "tip", "", None, "nested"), (4, 6, "note", "", "y", None), (7, None, "tip", "", None, "unclosed")]


def test_html_table_issues(spark):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td></td><td rowspan=2>x</td></tr><tr><td>a</td></tr></table>"
    got = [list(r.issues) for r in E.html_tables(docs(spark, html)).orderBy("row_no").collect()]
    assert got == [["span", "duplicate-key"], ["span", "empty-key"], ["span", "duplicate-key", "ragged"]]


@pytest.mark.parametrize(
    "base,local,remote,want,conflicts",
    [
        ("a b c", "a x b c", "a b c y", "a x b c y", 0),
        ("a b c", "a X c", "a X c", "a X c", 0),
        ("a b c", "a c", "a b c d", "a c d", 0),
        ("a b", "a p q b", "a p r b", "a p q r b", 0),
        ("", "x", "", "x", 0),
    ],
)
def test_three_way(spark, base, local, remote, want, conflicts):
    lines = lambda s: [x.replace("_", " ") for x in s.split()]
    assert M.three_way(lines(base), lines(local), lines(remote)) == (lines(want), conflicts)


def test_merge_properties(spark):
    rows = [(i, "\n".join(f"l{k % 5}" for k in range(i)), "\n".join(f"l{k % 5}" + "!" * (k % 7 == 1) for k in range(i))) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "doc_id long, b string, x string")
    pick = lambda b, l, r: {r.doc_id: r.merged for r in M.merge_three_way(df.select("doc_id", F.col(b).alias("base"), F.col(l).alias("local"), F.col(r).alias("remote"))).collect()}
    want = {i: x for i, _, x in rows}
    assert pick("b", "b", "x") == pick("b", "x", "b") == pick("b", "x", "x") == want


def test_insertions_come_first_on_ties():
    assert M.hunks(["B", "A", "A"], ["A"]) == [(0, 1, []), (2, 3, [])]
    assert M.hunks(["a"], ["b"]) == [(0, 1, ["b"])]
    assert M.apply_hunks(["B", "A", "A"], M.hunks(["B", "A", "A"], ["A"]), 0, 3) == ["A"]


def test_table_merge_without_remote_change_is_the_source(spark):
    base = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "table_key long, row_key int, c string")
    cur = spark.createDataFrame([(1, 1, "A"), (1, 2, "b"), (1, 3, "n")], "table_key long, row_key int, c string")
    got = {(r.row_key, r.c) for r in B.table_merge(base, cur, base, base, ["c"]).collect()}
    assert got == {(1, "A"), (2, "b"), (3, "n")}
    assert B.table_diff(base, base, ["c"]).isEmpty()


def test_a_rename_needs_the_same_place_and_a_stable_cell(spark):
    schema = "table_key long, row_key int, c string"
    base = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (2, 1, "a"), (2, 5, "b")], schema)
    cur = spark.createDataFrame([(1, 1, "a"), (1, 6, "b"), (2, 1, "a"), (2, 6, "z")], schema)
    got = {(r.table_key, r.base_row, r.current_row, r.how) for r in B.match_rows(base, cur, ["c"]).collect()}
    assert got == {(1, 1, 1, "key"), (1, 5, 6, "rename"), (2, 1, 1, "key")}


def test_a_direct_slug_beats_its_alias(spark):
    index = spark.createDataFrame([("a", "u1", "p"), ("b", "u2", "p"), ("b", "u3", "p")], "slug string, url string, placement string")
    aliases = spark.createDataFrame([("a", "b"), ("c", "a"), ("d", "b")], "alias string, target string")
    links = spark.createDataFrame([(s,) for s in "abcde"], "slug string")
    got = {r.slug: (r.source, r.resolved) for r in K.resolve_links(links, index, aliases, None).collect()}
    assert got == {"a": ("index", "u1"), "b": ("ambiguous", None), "c": ("index", "u1"), "d": ("ambiguous", None), "e": ("unresolved", None)}


def test_ambiguous_correspondence_is_reported(spark):
    schema = "g long, k int, v string"
    a, b = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (1, 2, "y")], schema), spark.createDataFrame([(1, 0, "x"), (1, 5, "y")], schema)
    got = {(r.base_key, r.current_key, r.how) for r in C.correspond_nodes(a, b, ["g"], "k", "v").collect()}
    assert got == {(2, 5, "value"), (0, 0, "ambiguous")}


def test_a_blocker_empties_the_plan(spark):
    plan = spark.createDataFrame([(1, "update", None), (1, None, "taken"), (2, "create", None)], "doc_id long, op string, blocker string")
    got = {r.doc_id: (r.ops, r.blockers) for r in P.scoped_plan([("text", plan)]).collect()}
    assert got == {1: (0, 1), 2: (1, 0)}


def test_latest_revision_never_goes_back(spark, tmp_path):
    sink = feeds.LatestRevisions(str(tmp_path))
    schema = "doc_id long, revision string"
    sink(spark.createDataFrame([(1, "9"), (1, "10"), (2, "b")], schema), 0)
    sink(spark.createDataFrame([(1, "2"), (2, "a"), (3, "1")], schema), 1)
    sink(spark.createDataFrame([(1, "2"), (2, "a"), (3, "1")], schema), 1)
    assert {tuple(r) for r in sink.read(spark).collect()} == {(1, "10"), (2, "b"), (3, "1")}


def test_includes_collapse_to_the_primary_view(spark):
    cases = {
        '<include target="alpha">A</include> \n <include target="beta">B</include> end': "A end",
        'x <include target="beta">B</include> y': "x  y",
        'x <include target="other">O</include> y': 'x <include target="other">O</include> y',
        "a\n<include>\nb\n</include>": "a\n\nb",
        "a\n\n<include target='gamma'>\n\nb": "a\n\nb",
    }
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    for r in df.select("text", "want", T.collapse_includes(F.col("text"), "alpha", "beta").alias("got")).collect():
        assert r.got == r.want, r.text


def test_slugs_of_links(spark):
    cases = {"./a/b.md": "b", "a/b.mdx#x": "b", "a/index.md": "a", "a/index": "a", "index.md": None, "a/b/": "b", "x%20y.md?q": "x y", "a+b": "a+b", "": None, "a\\b.md": "b"}
    df = spark.createDataFrame(list(cases.items()), "url string, want string")
    for r in df.select("url", "want", T.link_slug(F.col("url")).alias("got")).collect():
        assert r.got == r.want, r.url


def test_anchors_in_code_stay(spark):
    from textloom.operators import transform as X

    df = spark.createDataFrame([(1, "# One {#a}\n```\n## Two {#b}\n```\n   ### Three \\{#c-d\\} {#e}\ntext {#f}")], "doc_id long, text string")
    assert [r.line for r in X.strip_heading_anchors(df).orderBy("line_no").collect()] == ["# One", "```", "## Two {#b}", "```", "   ### Three \\{#c-d\\}", "text {#f}"]


def test_inline_runs_with_escapes(spark):
    from textloom.operators import extract as E

    df = spark.createDataFrame([(r"a **b** `c*d` \*no\* ==e== *f* [g\]h](./u) **i\*j**",)], "line string")
    got = [(r.kind, r.value) for r in E.inline_runs(df).orderBy("pos").collect()]
    assert [x for x in got if x[0] != "text"] == [("bold", "b"), ("code", "c*d"), ("highlight", "e"), ("italic", "f"), ("link", r"g\]h"), ("bold", r"i\*j")]
    assert ("text", "*") in got


def test_correspondence_survives_insertions_moves_and_edits(spark):
    schema = "doc_id long, pos long, section string, kind string, locator string, value string"
    base = [(1, i, "s", "text", f"s:{i}", v) for i, v in enumerate(["A", "B", "C", "same", "same", "D"])]
    now = [(1, i, "s", "text", f"s:{i}", v) for i, v in enumerate(["new", "A", "B edited", "D", "same", "same", "C", "end"])]
    got = {r.pos: r.locator for r in P.identified(spark.createDataFrame(base, schema), spark.createDataFrame(now, schema)).collect()}
    assert (got[1], got[3], got[6]) == ("s:0", "s:5", "s:2")  # equal values, wherever they went
    assert got[0] == "new|s:0" and got[7] == "new|s:7"
    # an edit between neighbours that stayed is the same node
    edited = [(1, i, "s", "text", f"s:{i}", v) for i, v in enumerate(["zero", "A", "B edited", "C", "same", "same!", "D"])]
    got = {r.pos: r.locator for r in P.identified(spark.createDataFrame(base, schema), spark.createDataFrame(edited, schema)).collect()}
    assert [got[i] for i in range(7)] == ["new|s:0", "s:0", "s:1", "s:2", "s:3", "s:4", "s:5"]


def test_text_plans_never_guess(spark):
    schema = "doc_id long, pos long, section string, kind string, locator string, value string"
    base, turned, coded = ["A", "B", "C"], ["B", "A", "C"], ["A", "code 1", "B"]
    order = {(None, None, "order-changed")}
    cases = [  # local base and current, remote base and current
        (base, turned, base, base, order), (base, ["A edited", "B", "C"], base, turned, order), (base, turned, base, turned, set()),
        (["A", "X", "X", "B"], ["A", "X", "X", "X", "B"], ["A", "X", "X", "B"], ["A", "X", "X", "B"], {(None, None, "ambiguous-repeats")}),
        (["A", "X", "X"], ["A", "X!", "X"], ["A", "X", "X"], ["A", "X", "X"], {("s:1", "update", None)}),
        (coded, ["code 1", "A", "B"], coded, coded, set()),  # code may move
    ]
    side = lambda k: spark.createDataFrame([(d, i, "s", "code" if v.startswith("code") else "text", f"s:{i}", v) for d, case in enumerate(cases) for i, v in enumerate(case[k])], schema)
    got = {d: set() for d in range(len(cases))}
    for r in P.text_plan(*map(side, range(4))).collect():
        got[r.doc_id].add((r.locator, r.op, r.blocker))
    assert got == {d: case[4] for d, case in enumerate(cases)}


def test_a_renamed_row_is_an_update(spark):
    schema = "table_key long, row_key int, c string, d string"
    remote = spark.createDataFrame([(1, 1, "a", "x"), (1, 5, "b", "y"), (2, 1, "a", "x")], schema)
    source = spark.createDataFrame([(1, 1, "a", "x"), (1, 6, "b", "z"), (2, 2, "q", "q")], schema)
    diff = lambda **k: {(r.table_key, r.row_key, r.change, r.cells, r.blocker) for r in B.table_diff(remote, source, ["c", "d"], **k).collect()}
    rest = {(2, 1, "deleted", "", True), (2, 2, "added", "", False)}
    assert diff(allow_rename=True) == {(1, 6, "updated", "row_key,d", False)} | rest
    assert diff() == {(1, 5, "deleted", "", True), (1, 6, "added", "", False)} | rest


def test_table_blockers(spark):
    rows = lambda *r: spark.createDataFrame([(t, k, i) for t, ks in r for i, k in enumerate(ks)], "table_key long, row_key string, pos int")
    heads = lambda *h: spark.createDataFrame(list(enumerate(h)), "table_key long, headers array<string>")
    remote = rows((0, ["a", "b"]), (1, ["a", "b"]), (2, ["a", "b"]), (3, ["a", "b"]), (4, ["a", None]), (5, ["a"]))
    source = rows((0, ["x", "a", "b"]), (1, ["b", "a"]), (2, ["b"]), (3, ["b", "a", "a"]), (4, ["a", ""]), (6, ["a"]))
    rh, sh = heads(["k", "v"], ["k", "v"], ["k", "v"], ["k", "v"], ["k", "v"], ["k"]), heads(["k", "v"], ["k", "v"], ["k", "w"], ["k"], ["k", "v"])
    got = lambda **k: {(r.table_key, r.blocker, r.row_key) for r in B.table_blockers(remote, source, rh, sh, **k).collect()}
    strict = {(1, "reorders-rows", None), (2, "headers-differ", None), (2, "deletes-row", "a"), (3, "headers-differ", None), (3, "source-duplicate-key", "a"), (4, "remote-empty-key", ""), (4, "source-empty-key", "")}
    assert got() == strict
    assert got(allow_header_changes=True) == strict - {(2, "headers-differ", None)}
    renamed = spark.createDataFrame([(2, "a", "b")], "table_key long, base_row string, current_row string")
    assert (2, "deletes-row", "b") in got(renamed=renamed) and (2, "deletes-row", "a") not in got(renamed=renamed)


def test_records_of_variables_merge(spark):
    variables = [("", "a.x", "1"), ("", "a.y", "2"), ("", "b", "3"), ("", "c.d.e", "4"), ("f", "a.x", "5"), ("f", "b.z", "6"), ("f", "c", "7"), ("f/g", "c.d.e", "8")]
    df = spark.createDataFrame(variables, "dir string, name string, value string")
    docs = spark.createDataFrame([(1, ""), (2, "/f/"), (3, "f/g/h")], "doc_id long, dir string")
    got = {}
    for r in S.layer_variables(df, docs).collect():
        got.setdefault(r.doc_id, {})[r.name] = r.value
    assert got == {1: {"a.x": "1", "a.y": "2", "b": "3", "c.d.e": "4"}, 2: {"a.x": "5", "a.y": "2", "b.z": "6", "c": "7"}, 3: {"a.x": "5", "a.y": "2", "b.z": "6", "c.d.e": "8"}}


def test_variables_are_layered_by_folder_not_by_document(spark):
    variables = spark.createDataFrame([("", "a", "1"), ("f", "a", "2"), ("f", "b.c", "3")], "dir string, name string, value string")
    docs = spark.range(1000).selectExpr("id AS doc_id", "CASE WHEN id % 4 = 3 THEN NULL WHEN id % 2 = 0 THEN 'f' ELSE '/g/' END AS dir")
    out = S.layer_variables(variables, docs)
    assert out.count() == 500 * 2 + 250 and {(r.doc_id, r.name, r.value) for r in out.filter("doc_id < 4").collect()} == {(0, "a", "2"), (0, "b.c", "3"), (1, "a", "1"), (2, "a", "2"), (2, "b.c", "3")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan  # the documents' own rows meet a table of folders, and nothing groups them


def test_tables_without_rows_correspond(spark):
    schema = "table_key long, name string, row_key string"
    source = spark.createDataFrame([(1, "t", None), (2, "u", "a"), (3, "v", None)], schema)
    remote = spark.createDataFrame([(7, "t", None), (8, "u", None), (9, "v", None), (10, "v", None)], schema)
    assert {(r.table_key, r.state) for r in B.match_tables(source, remote, "name").collect()} == {(1, "matched"), (2, "missing"), (3, "ambiguous")}


def test_profile_warnings(spark):
    text = '<include>1</include><exclude target="x, y z">2</exclude><include target="x">3</include><include target="">4</include>'
    assert one(spark, text, lambda c: T.profile_warnings(c, ["x"])) == ["include:no-target", "exclude:unknown:y,z", "include:no-target"]


def test_frontmatter_keys_twice_and_nested(spark):
    assert one(spark, "---\na: 1\nb: 2\na: 3\n---", T.frontmatter_scalars) == {"a": "3", "b": "2"}
    assert one(spark, "---\n---", T.frontmatter_scalars) == {}
    assert [one(spark, v, T.frontmatter_nested) for v in ("---\na: 1\n---", "---\na:\n  b: 1\n---", "---\ntags:\n- x\n---", None)] == [False, True, True, None]


def test_baselines_by_receipt_version(spark):
    sha = lambda x: F.sha2(F.lit(x), 256)
    receipts = spark.createDataFrame([(i, v) for i, v in enumerate([1, 1, 1, 2, 3, 3, 4, 5, 5])], "doc_id long, version int").select("*", sha("L").alias("draft_hash"), sha("R").alias("remote_hash"))
    kept = spark.createDataFrame([(2, "L", None), (4, "L", "R"), (5, "L", "other"), (6, None, "R"), (7, "L", "R"), (8, "L", None)], "doc_id long, local string, remote string")
    now = spark.createDataFrame([(0, "L", "R"), (1, "new", "R"), (2, "new", "new"), (3, "L", "R"), (4, "new", "new"), (6, "L", "R"), (7, "new", "new")], "doc_id long, local string, remote string")
    got = {r.doc_id: (r.local_base, r.remote_base, r.blocker) for r in S.load_baselines(receipts, kept, now).collect()}
    both, none = ("L", "R", None), lambda b: (None, None, b)
    assert got == {0: both, 1: none("local-base-missing"), 2: none("remote-changed"), 3: none("remote-base-missing"), 4: both, 5: none("remote-base-missing"), 6: none("draft-base-missing"), 7: both, 8: none("remote-base-missing")}


def test_one_fingerprint_over_many_ranges(spark, many_ranges):
    requests = spark.range(600).selectExpr("'hot' AS fingerprint", "id", "timestamp_seconds(id * 10 + 5) AS ts").repartition(5)
    snapshots = spark.range(60).selectExpr("'hot' AS fingerprint", "timestamp_seconds(id * 100 + 50) AS fetched_at", "CAST(id AS string) AS snapshot_id").union(spark.sql("SELECT 'cold', timestamp_seconds(1), 'c'"))
    got = {r.id: (r.snapshot_id, r.state) for r in K.index_as_of(requests, snapshots, "30 seconds", F.lit(False)).collect()}
    newest = {i: (i * 10 + 5 - 50) // 100 for i in range(600)}
    assert got == {i: (None, "none") if n < 0 else (str(n), "fresh" if i * 10 + 5 < n * 100 + 80 else "stale") for i, n in newest.items()}


def test_baselines_of_some_documents_leave_the_others(spark, tmp_path):
    path = str(tmp_path / "base")
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    S.write_baseline(docs((1, "a"), (2, "b")), path)
    S.write_baseline(docs((3, "c")), path)
    S.write_baseline(docs((2, "B")), path)
    # a run that stopped before its commit
    docs((1, "lost")).withColumn("hash", F.sha2("text", 256)).write.parquet(f"{path}/snapshots/00000009-x")
    texts = {r.doc_id: (r.run, r.text, r.snapshot_hash) for r in S.read_baseline(spark, path, with_text=True).collect()}
    sha = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    assert texts == {1: (1, "a", sha("a")), 2: (3, "B", sha("B")), 3: (2, "c", sha("c"))}
    assert {(r.doc_id, r.snapshot_hash) for r in S.compact_baseline(spark, path, str(tmp_path / "less")).collect()} == {(i, t[2]) for i, t in texts.items()}


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    sink = feeds.LatestRevisions(str(tmp_path), fan=4)
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, revision string")
    size = lambda folder: sum(f.stat().st_size for f in (tmp_path / folder).glob("*.parquet"))
    sink(spark.range(50_000).selectExpr("id AS doc_id", "'1' AS revision"), 0)
    want = {i: "1" for i in range(50_000)}
    for n in range(1, 18):
        batch = [(n, str(n)), (n + 1, "0"), (100_000 + n, "7")]
        for _ in range(2 if n in (3, 7, 15) else 1):  # batches that merge run twice
            sink(rows(*batch), n)
        want[n], want[100_000 + n] = str(max(n, int(want[n]))), "7"
        assert size(f"{n}-{n}") < size("0-0" if n < 4 else "0-3" if n < 16 else "0-15") / 20
    assert sink.widest(sink.folders(spark)) == [(0, 15), (16, 16), (17, 17)] and len(sink.folders(spark)) == 3
    assert {r.doc_id: r.revision for r in sink.read(spark).collect()} == want
