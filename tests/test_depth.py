"""Nesting beyond any fixed depth."""

import time

from pyspark.sql import functions as F
from textloom.operators import extract, lines, transform, trees
from textloom.plans import nodes


def test_deep_trees_and_cycles(spark):
    rows = [("b0", None, 0)] + [(f"b{i}", f"b{i - 1}", 0) for i in range(1, 70)] + [("x", "y", 1), ("y", "x", 1)]
    blocks = spark.createDataFrame(rows, "block_id string, parent_id string, pos long").withColumn("payload", trees.F.col("block_id"))
    assert {(r.block_id, r.depth, r.n) for r in trees.preorder(blocks).collect()} == {(f"b{i}", i, i) for i in range(70)}
    tops = spark.createDataFrame([("b40",), ("x",)], "block_id string")
    assert {(r.top, r.block_id) for r in trees.descendants(blocks, tops).collect()} == {("b40", f"b{i}") for i in range(40, 70)} | {("x", "x"), ("x", "y")}


def test_long_chains_of_fragments(spark):
    parts = [("f0", "end")] + [(f"f{i}", f"{i} {{{{> f{i - 1}}}}}") for i in range(1, 13)] + [("a", "{{> b}}"), ("b", "{{> a}}"), ("c", "{{> gone}}"), ("d", "{{> f0}} {{> c}} {{> a}}")]
    docs = spark.createDataFrame([(1, "{{> f12}}"), (2, "{{> a}} {{> nowhere}} {{> ../up}}"), (3, "{{> c}}"), (4, "{{> f0}} {{> d}}")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.unresolved) for r in transform.expand_fragments(docs, spark.createDataFrame(parts, "name string, text string")).collect()}
    assert got[1] == (" ".join(map(str, range(12, 0, -1))) + " end", "")
    assert got[2] == ("{{> a}} {{> nowhere}} {{> ../up}}", "../up:escaping,a:cycle a > b > a,nowhere:missing")
    assert got[3] == ("{{> c}}", "c:missing c > gone")
    assert got[4] == ("end {{> d}}", "d:missing d > c > gone")  # its other way is a cycle


def test_long_alias_chains(spark):
    aliases = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(40)] + [("a40", "python"), ("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("d1", "d2")], "alias string, target string")
    codes = spark.createDataFrame([("a0",), ("a17",), ("python",), ("l1",), ("d1",), ("zz",), ("",)], "language string")
    got = {r.language: (r.resolved, r.issue) for r in extract.resolve_language(codes, aliases, ["python"]).collect()}
    assert got == {"a0": ("python", None), "a17": ("python", None), "python": ("python", None), "l1": (None, "cycle"), "d1": (None, "unsupported"), "zz": (None, "unsupported"), "": (None, None)}


def test_lists_of_any_indent(spark):
    indents = [0, 4, 8, 12, 40, 12, 6, 0, 3]
    rows = nodes.list_tree(spark.createDataFrame([(1, i, n) for i, n in enumerate(indents)], "doc_id long, pos long, indent int")).collect()
    assert {r.pos: r.parent for r in rows} == {0: None, 1: 0, 2: 1, 3: 2, 4: 3, 5: 2, 6: 1, 7: None, 8: 7}


def test_long_documents_and_lists_take_no_quadratic_time(spark):
    def line(i):
        return "```" if i % 10 in (3, 5) else "- item" if i % 10 == 7 else "" if i % 10 == 8 else f"line {i}"

    docs = spark.createDataFrame([(1, "\n".join(map(line, range(200_000)))), (2, "a\n\nb"), (3, ""), (4, "~~~\nx")], "doc_id long, text string")
    began = time.monotonic()
    rows = lines.line_offsets(docs).agg(F.count(F.lit(1)), F.max("stop"), F.sum(F.col("stop") - F.col("start") - F.length("line"))).first()
    assert tuple(rows) == (200_000 + 3 + 2, sum(len(line(i)) + 1 for i in range(200_000)) - 1, 200_000 - 1 + 2 + 1)
    blocks = lines.extract_blocks(docs)
    assert {(r.kind, r["count"]) for r in blocks.filter("doc_id = 1").groupBy("kind").count().collect()} == {("code", 20_000), ("paragraph", 40_001), ("bullet", 20_000)}
    assert [(r.kind, r.text) for r in blocks.filter("doc_id > 1").orderBy("doc_id", "block_no").collect()] == [("paragraph", "a"), ("paragraph", "b"), ("code", "~~~\nx")]
    assert lines.fence_ranges(docs).filter("closed").count() == 20_000
    items = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), (F.col("id") % 5).alias("indent"))
    assert nodes.list_tree(items).filter("parent = pos - 1").count() == 80_000
    assert time.monotonic() - began < 60
