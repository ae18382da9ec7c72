"""Block trees back to Markdown, from the leaves up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.fold import STRETCH, fold_up
from textloom.operators.lines import bind
from textloom.operators.ranges import numbered
from textloom.runtime import materialize

#: Fixed values of the block format.
PAGE, TEXT, HEADINGS, BULLET, ORDERED, CODE, CALLOUT, TABLE, SYNCED = 1, 2, range(3, 9), 12, 13, 14, 19, 31, 49
_BREAK = "\x1f"


def _children(rows: DataFrame, level: DataFrame) -> DataFrame:
    """(doc_id, parent_id, below): the children's texts in order. Only those of parents with more than a stretch are numbered, and put together in stretches."""
    keys = ["doc_id", "parent_id"]
    in_order = lambda *at: F.array_compact(F.transform(F.sort_array(F.collect_list(F.struct(*at, "folded"))), lambda x: x["folded"]))
    listed = lambda some: some.groupBy(*keys).agg(in_order("ordinal", "block_id").alias("below"))
    many = materialize(level.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > STRETCH).select(*keys), "render-many")
    if many.isEmpty():
        return listed(rows)
    large = numbered(rows.join(F.broadcast(many), keys, "left_semi"), keys, ["ordinal", "block_id"], "at")
    parts = large.groupBy(*keys, F.floor(F.col("at") / STRETCH).alias("stretch")).agg(in_order("at").alias("folded"))
    return listed(rows.join(F.broadcast(many), keys, "left_anti")).unionByName(parts.groupBy(*keys).agg(F.flatten(in_order("stretch")).alias("below")))


def render_tree(blocks: DataFrame, callout_titles: dict[str, str] | None = None) -> DataFrame:
    """doc_id, text of each page: blocks (doc_id, block_id, parent_id, pos, block_type, text, language, columns), children in order of pos.

    Paragraphs, headings, lists (children indented by four), fenced code, tables (children are the cells, row by row, ``columns`` wide; the first row has
    the headers), callouts (a first child whose text is one of ``callout_titles`` gives the type and goes; else a note) and synced containers; other types leave a
    comment. Blank parts vanish. Text is taken as it is, without the control character 0x1F.
    """
    titles = callout_titles or {"note": "note", "warning": "warning"}
    held = blocks.withColumn("text", F.translate(F.coalesce("text", F.lit("")), _BREAK, "")).withColumnRenamed("pos", "ordinal")
    kind, text, wide = F.col("block_type"), F.col("text"), F.col("columns")

    def own(below: Column) -> Column:
        return bind(F.coalesce(below, F.array().cast("array<string>")), lambda cells: bind(F.filter(cells, lambda p: p.rlike(r"\S")), lambda parts: bind(F.array_join(parts, "\n\n"), lambda joined: whole(cells, parts, joined))))

    def whole(cells: Column, parts: Column, joined: Column) -> Column:
        item = lambda mark: F.concat(F.lit(mark), text, F.when(joined != "", F.concat(F.lit("\n\n"), F.regexp_replace(joined, "(?m)^(?=.)", "    "))).otherwise(""))
        row = lambda values: F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))
        n_rows = F.when(wide > 0, F.ceil(F.size(cells) / wide)).otherwise(0).cast("int")
        cell = lambda r, c: F.coalesce(F.get(cells, r * wide + c), F.lit(""))
        rows = F.transform(F.sequence(F.lit(0), F.greatest(n_rows - 1, F.lit(0))), lambda r: row(F.transform(F.sequence(F.lit(0), wide - 1), lambda c: cell(r, c))))
        rule = row(F.transform(F.sequence(F.lit(0), wide - 1), lambda c: F.lit("---")))
        table = F.when(n_rows > 0, F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, F.greatest(n_rows - 1, F.lit(0)))), "\n")).otherwise("")
        first = F.lower(F.trim(F.regexp_replace(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), r"[*_:]", "")))
        given = reduce(lambda done, t: F.when(first == t[0], F.lit(t[1])).otherwise(done), titles.items(), F.lit(None).cast("string"))
        body = F.array_join(F.when(given.isNotNull(), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts), "\n\n")
        callout = F.concat(F.lit('<div class="alert '), F.coalesce(given, F.lit("note")), F.lit('">\n\n'), body, F.lit("\n\n</div>"))
        return (
            F.when(kind == PAGE, F.when(joined != "", F.concat(joined, F.lit("\n"))).otherwise("")).when(kind == TEXT, text)
            .when(kind.isin(*HEADINGS), F.concat(F.repeat(F.lit("#"), kind - 2), F.lit(" "), text)).when(kind == BULLET, item("- ")).when(kind == ORDERED, item("1. "))
            .when(kind == CODE, F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), text, F.lit("\n```"))).when(kind == TABLE, table).when(kind == CALLOUT, callout).when(kind == SYNCED, joined)
            .otherwise(F.concat(F.lit("<!-- block type "), kind.cast("string"), F.lit(" omitted -->")))
        )

    folded = fold_up(held, own, children=_children, below_type="array<string>", roots_only=True)
    return folded.select("doc_id", F.col("folded").alias("text"))
