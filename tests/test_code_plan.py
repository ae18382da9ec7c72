"""Plans for code nodes: literal cases of four versions."""

from textloom.plans.code import code_plan
from textloom.plans.match import match_in_order

SCHEMA = "doc_id long, pos long, section string, kind string, locator string, value string, language string, caption string, issue string"


def nodes(doc, *values):
    """A text node is a plain string; code is (content, language, caption, issue)."""
    rows, n = [], {"text": 0, "code": 0}
    for i, v in enumerate(values):
        kind = "text" if isinstance(v, str) else "code"
        content, language, caption, issue = (*((v,) if kind == "text" else v), *(None,) * 4)[:4]
        rows.append((doc, i, "s", kind, f"{kind}:{n[kind]}", content, language, caption, issue))
        n[kind] += 1
    return rows


def c(content, language="py", caption=None, issue=None):
    return (content, language, caption, issue)


A, B, C = c("a"), c("b"), c("c")


def among(*codes):
    """Code after one text each; what is None is left out."""
    return tuple(x for text, code in zip("tuv", codes) for x in (text, code) if x is not None)


BASE = among(A, B, C)
#: base, local, remote -> {(op or blocker, field, locator, content)}
CASES = [
    (BASE, BASE, BASE, set()),
    (BASE, among(A, c("B"), C), BASE, {("update", None, "code:1", "B")}),
    ((A, B), (c("L"), B), (A, B), {("update", None, "code:0", "L"), ("move", None, "code:1", "b")}),  # behind other code now
    (BASE, BASE, among(A, c("R"), C), set()),
    (BASE, among(A, c("L"), C), among(A, c("R"), C), {("remote-code-conflict", "content", "code:1", None)}),
    (BASE, among(A, c("b", "go"), C), among(A, c("b", "rs"), C), {("remote-code-conflict", "language", "code:1", None)}),
    (BASE, among(A, c("L"), C), among(A, c("b", "go"), C), {("update", None, "code:1", "L")}),  # content of one side, language of the other
    # the second takes the row at its place, which leaves none for the third
    (BASE, BASE, among(A, None, C), {("remote-code-conflict", "deletion", "code:2", None)}),
    (BASE, among(A, None, C), BASE, {("update", None, "code:1", "c"), ("move", None, "code:1", "c"), ("delete", None, "code:2", None)}),
    (("t", A), ("t",), ("t", c("R")), {("remote-code-conflict", "deletion", "code:0", None)}),
    (("t", A, "u"), ("t", "u", A), ("t", A, "u"), {("move", None, "code:0", "a")}),
    (("t", A, "u"), ("t", "u", A), ("t", "u", A), set()),
    (("t", A, "u", "v"), ("t", "u", A, "v"), ("t", "u", "v", A), {("remote-code-conflict", "position", "code:0", None)}),
    (("t", A), ("t", A, "u", B), ("t", A), {("create", None, "code:1", "b")}),
    (("t", A, "u", B), ("t", c("x"), "u", c("y", issue="mixed")), ("t", A, "u", B), {("issue:mixed", None, "code:1", None)}),
]


def test_cases(spark):
    side = lambda k: spark.createDataFrame([r for i, case in enumerate(CASES) for r in nodes(i, *case[k])], SCHEMA)
    got = {i: set() for i in range(len(CASES))}
    for r in code_plan(side(0), side(1), side(0), side(2)).collect():
        got[r.doc_id].add((r.op or r.blocker, r.field, r.locator, r.content))
    assert got == {i: case[3] for i, case in enumerate(CASES)}


def test_sections_whose_code_corresponds_to_nothing_are_rebuilt(spark):
    code = lambda doc, *rows: [(doc, i, s, "code", f"{s}:{n}", v, "py", cap, None) for i, (s, n, v, cap) in enumerate(rows)]
    base, local, changed, captioned = ((("s", n, v, cap), ("t", 0, "z", None)) for n, v, cap in ((0, "a", None), (5, "new", None), (0, "changed", None), (0, "a", "Figure")))
    remotes = (base, changed, captioned)
    sides = [spark.createDataFrame([r for i, now in enumerate(remotes) for r in code(i, *(now if k == 3 else local if k == 1 else base))], SCHEMA) for k in range(4)]
    got = {(r.doc_id, r.op or r.blocker, r.section, r.locator) for r in code_plan(*sides).collect() if r.op in ("reconcile", "delete") or r.blocker}
    assert (0, "reconcile", "s", None) in got and (0, "delete", "s", "s:0") not in got
    assert (1, "remote-code-scope-changed", None, "s:5") in got and (2, "caption-correspondence-ambiguous", None, "s:0") in got


def test_each_row_takes_what_earlier_ones_left(spark):
    row = lambda doc, i, key, loc: (doc, i, key, loc)
    schema = "doc_id long, pos long, key string, locator string"
    base = spark.createDataFrame([row(1, 0, "x", "p0"), row(1, 1, "x", "p1"), row(1, 2, "x", "p2"), row(2, 0, "y", "q"), row(2, 1, "y", "r")], schema)
    now = spark.createDataFrame([row(1, 0, "x", "p1"), row(1, 1, "x", "p0"), row(1, 2, "x", "z"), row(2, 0, "y", "r")], schema)
    rules = [("content", ["key"], True), ("place", ["locator"], False)]
    got = {(r.doc_id, r.base_id, r.current_id, r.how) for r in match_in_order(base, now, rules).collect()}
    # two x are taken by place, which leaves one that is unique; in document 2 the first base row takes the only y
    assert got == {(1, "p0", "p0", "place"), (1, "p1", "p1", "place"), (1, "p2", "z", "content"), (2, "q", "r", "content")}
