"""Rendering reads the blocks once for each level and numbers only the children of very large parents."""

from textloom.operators import fold, ranges, render

SCHEMA = "doc_id long, block_id string, parent_id string, pos long, block_type int, text string, language string, columns int"
BLOCKS = [(1, "p", None, 0, 1, "", None, 0)] + [(1, f"i{i}", "p", 9 - i // 2, 12, f"item {i}", None, 0) for i in range(10)] + [(1, f"n{i}", "i0", i, 2, " " if i == 1 else f"text {i}", None, 0) for i in range(3)]
BLOCKS += [(2, "p", None, 0, 1, "", None, 0), (3, "x", "gone", 0, 2, "orphan", None, 0), (4, "p", None, 0, 1, "", None, 0), (4, "t", "p", 0, 31, "", None, 2)] + [(4, f"c{i}", "t", i, 2, "" if i == 1 else f"c{i}", None, 0) for i in range(5)]
ITEMS = ["- item 8", "- item 9", "- item 6", "- item 7", "- item 4", "- item 5", "- item 2", "- item 3", "- item 0\n\n    text 0\n\n    text 2", "- item 1"]
WANT = {1: "\n\n".join(ITEMS) + "\n", 2: "", 4: "| c0 |  |\n| --- | --- |\n| c2 | c3 |\n| c4 |  |\n"}


def test_pages_with_and_without_large_parents(spark, monkeypatch):
    blocks, written = spark.createDataFrame(BLOCKS, SCHEMA), []
    for module in (fold, render, ranges):
        monkeypatch.setattr(module, "materialize", lambda df, label, *rest, real=module.materialize, **more: (written.append(label), real(df, label, *rest, **more))[1])
    assert {r.doc_id: r.text for r in render.render_tree(blocks).collect()} == WANT
    assert "running" not in written and written.count("fold-level") == 4  # three levels, and the orphan's way to none
    monkeypatch.setattr(render, "STRETCH", 3)
    monkeypatch.setattr(fold, "UNWRITTEN", 1)
    assert {r.doc_id: r.text for r in render.render_tree(blocks).collect()} == WANT and "running" in written
    del written[:]
    render.render_tree(blocks.filter("doc_id < 3"))
    assert written.count("fold-level") == 3
