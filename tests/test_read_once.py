"""Jobs that need their input several times derive it once, and blocks meet as tables of ids."""

from pyspark.sql import functions as F

from textloom.operators import compare, linkrewrite, trees


def counting(spark, df, column):
    """``df`` with a column that counts how often its rows are derived."""
    seen = spark.sparkContext.accumulator(0)

    def run(value):
        seen.add(1)
        return value

    return df.withColumn(column, F.udf(run, df.schema[column].dataType)(column)), seen


def test_link_drafts_derive_each_text_once(spark):
    docs, seen = counting(spark, spark.createDataFrame([(1, "[a](./one.md) ![i](./one.md)"), (2, "![i](./one.md)"), (3, None)], "doc_id long, text string"), "text")
    index, aliases = spark.createDataFrame([("one", "https://i/1")], "slug string, url string"), spark.createDataFrame([], "alias string, target string")
    got = {r.doc_id: r.draft for r in linkrewrite.link_drafts(docs, "p", ["p"], index, aliases).collect()}
    assert got == {1: "[a](https://i/1) ![i](./one.md)", 2: "![i](./one.md)", 3: ""} and seen.value == 3


def test_corresponding_nodes_derive_each_value_once(spark):
    schema = "g long, k int, v string"
    base, seen = counting(spark, spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (1, 2, "y"), (1, 3, "p"), (1, 4, None), (1, 6, "z"), (2, 0, "y"), (None, 1, "n")], schema), "v")
    current = spark.createDataFrame([(1, 0, "x"), (1, 5, "y"), (1, 3, "q"), (1, 4, None), (1, 6, "x"), (1, 7, "x"), (2, 1, "z"), (None, 1, "n")], schema)
    got = sorted(tuple(r) for r in compare.correspond_nodes(base, current, ["g"], "k", "v").collect())
    assert got == [(1, 0, 0, "ambiguous"), (1, 2, 5, "value"), (1, 3, 3, "key"), (1, 6, 6, "key")] and seen.value <= 2 * 8  # in one pass: the filter and the hash


def test_snapshot_faults_derive_blocks_few_times(spark):
    blocks, seen = counting(spark, spark.createDataFrame([("r", None, 0), ("a", "r", 0), ("b", "a", 0), ("c", "b", 0), ("c", "zz", 0), ("d", "zz", 0), ("d", "yy", 0)], "block_id string, parent_id string, pos long"), "parent_id")
    refs = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "c"), ("b", "c"), ("a", "gone"), ("a", "hence")], "parent_id string, child_id string")
    got = sorted(tuple(r) for r in trees.validate_snapshot(blocks, refs).collect())
    assert got == [("a", "missing-child"), ("b", "duplicate-child"), ("c", "duplicate-id"), ("c", "missing-parent"), ("c", "parent-disagrees"), ("d", "duplicate-id"), ("d", "missing-parent"), ("d", "unreachable"), ("d", "unreferenced")]
    assert seen.value <= 5 * 7
