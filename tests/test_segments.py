"""Segments put a text together again, whatever it holds, and odd markup is read as it stands."""

import random

from textloom.operators import segments as G


def test_segments_are_the_whole_text(spark):
    rng = random.Random(3)
    bits = ["```\n", "~~~~\n", "    ```\n", "<table>", "</table>", "<div>", "</div>", '<div class="note alert">', "text ", "\n", "<TABLE a='b'>", "x<y>"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(25))) for _ in range(300)] + [None, "", "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = {}
    for r in G.segments(docs).orderBy("doc_id", "seg").collect():
        parts.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        own = parts.get(i, [])
        assert "".join(r.content for r in own) == (text or "")
        assert all(a.kind != "markdown" or b.kind != "markdown" for a, b in zip(own, own[1:]))
        for r in own:
            if r.kind in ("table", "div", "callout"):
                tag = "table" if r.kind == "table" else "div"
                assert r.content.lower().count(f"<{tag}") == r.content.count(f"</{tag}") and r.content.endswith(">")
            assert r.kind == "markdown" or not r.kind.startswith("open") or r is own[-1]


def test_empty_and_long(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert G.segments(docs).count() == 0 and G.local_nodes(docs).count() == 0 and G.html_table_nodes(docs).count() == 0
    assert [r.text for r in G.drop_containers(docs, "x").collect()] == ["", ""]
    long = "".join(f"line {i}\n```\ncode {i}\n```\n<table><tr><td>{i}</td></tr></table>\n" for i in range(20_000))
    kinds = {r.kind: r["count"] for r in G.segments(spark.createDataFrame([(1, long)], "doc_id long, text string")).groupBy("kind").count().collect()}
    assert kinds == {"markdown": 40_000 // 2 + 1, "code": 20_000, "table": 20_000}


def test_links_are_rewritten_in_place_and_never_in_code(spark):
    from textloom.operators import linkrewrite as W

    text = "a [x](./one.md) `[c](./one.md)` ![i](./one.md)\n```\n[f](./one.md)\n```\n[two]( ./no) [y](two.md#s)[z](#here) [gone](../gone.md?q#t) [w](https://e.com/one.md)\n[many](many.md) \U0001f600 [x](./one.md)"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "[r](index.md)")], "doc_id long, text string")
    index = spark.createDataFrame([("one", "https://i/1"), ("many", "https://i/a"), ("many", "https://i/b"), ("deux", "https://i/2")], "slug string, url string")
    aliases = spark.createDataFrame([("two", "deux")], "alias string, target string")
    for r in W.document_links(docs).collect():
        assert (text if r.doc_id == 1 else "[r](index.md)")[r.start : r.stop] == r.url
    got = {r.doc_id: r for r in W.rewrite_links(docs, index, aliases, "https://site/").collect()}
    want = text.replace("a [x](./one.md)", "a [x](https://i/1)").replace("\U0001f600 [x](./one.md)", "\U0001f600 [x](https://i/1)").replace("two.md#s", "https://i/2").replace("../gone.md?q#t", "https://site/gone#t")
    assert got[1].text == want
    assert got[1].blockers == ["ambiguous-link many.md 6:1"] and got[1].warnings == ["public-fallback ../gone.md?q#t 5:38"]
    assert (got[2].text, got[2].blockers) == ("", []) and got[3].blockers == ["unresolved-link index.md 1:1"]
    drafts = {r.doc_id: r.draft for r in W.link_drafts(docs, "p", ["p"], index, aliases).collect()}
    assert drafts == {1: None, 2: "", 3: None}


def test_segments_are_read_in_one_pass(spark):
    text = "a\r```x\n<div>\n```\n<TABLE><tr><td>1<table></table></TABLE> <divx><div/></div>b\n    ~~~\n</div>\n    ~~~~\n</table><div class='alert  note'>\n```\n</div>"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = G.segments(docs)
    got = [tuple(r) for r in found.orderBy("seg").collect()]
    assert [r[2] for r in got] == ["markdown", "code", "table", "markdown", "div", "markdown", "indented", "markdown", "callout"]
    assert "".join(r[4] for r in got) == text and got[2][3] == "<TABLE>" and got[4][4] == "<div/></div>" and got[6][4] == "    ~~~\n</div>\n    ~~~~\n"
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no fold row by row in the plan
