"""Lines, code ranges, blocks and their place in a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line: line_no and line (without its end), beside the other columns."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(items: Column, carry: Column, emitted: str, step: Callable[[Column, Column], tuple[Column, Column]], rest: Callable[[Column], Column] | None = None) -> Column:
    """What ``step`` (state, item) -> (state, array to emit) emits over an array, in order; ``rest`` of the last state follows.

    Lists can't be appended to in place, so a plain fold copies what it has for each item. This one folds stretches of stretches and puts their
    lists together at their ends: an array of n items costs n to the power 4/3 in copied references.
    """
    empty = F.array().cast(f"array<{emitted}>")

    def one(s: Column, item: Column) -> Column:
        new, out = step(s["carry"], item)
        return F.struct(new.alias("carry"), F.concat(s["out"], out).alias("out"))

    def stretch(part: Column, state: Column, depth: int) -> Column:
        if depth == 1:
            return F.aggregate(part, F.struct(state.alias("carry"), empty.alias("out")), one)
        size = F.greatest(F.ceil(F.pow(F.size(part).cast("double"), F.lit((depth - 1) / depth))).cast("int"), F.lit(1))
        parts = bind(size, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(part) / n).cast("int") - 1, F.lit(0))), lambda k: F.slice(part, k * n + 1, n)))
        start = F.struct(state.alias("carry"), F.array().cast(f"array<array<{emitted}>>").alias("out"))
        whole = F.aggregate(parts, start, lambda s, p: bind(stretch(p, s["carry"], depth - 1), lambda r: F.struct(r["carry"].alias("carry"), F.concat(s["out"], F.array(r["out"])).alias("out"))))
        return bind(whole, lambda r: F.struct(r["carry"].alias("carry"), F.flatten(r["out"]).alias("out")))

    return bind(bind(items, lambda whole: stretch(whole, carry, 3)), lambda r: F.concat(r["out"], rest(r["carry"])) if rest else r["out"])


def line_offsets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lines with ``start`` and ``stop``, half-open offsets in the text, ends counted with their line feed.

    The running sum stays inside the document's own array: no window, no shuffle.
    """
    keep = [c for c in docs.columns if c != text]
    # the last line has no line feed
    sized = lambda a: F.transform(a, lambda x, i: F.struct(x.alias("line"), (F.length(x) + F.when(i < F.size(a) - 1, 1).otherwise(0)).alias("n")))
    row = lambda at, x: F.struct(x["line"].alias("line"), at.alias("start"), (at + x["n"]).alias("stop"))
    found = fold(bind(F.split(F.col(text), "\n"), sized), F.lit(0), "struct<line:string,start:int,stop:int>", lambda at, x: (at + x["n"], F.array(row(at, x))))
    return docs.select(*keep, F.posexplode(found).alias("line_no", "r")).select(*keep, "line_no", "r.line", "r.start", "r.stop").filter("stop > start OR line <> ''")


FENCE = r"^ {0,3}(`{3,}|~{3,})"


def fence_ranges(docs: DataFrame, strict_close: bool = False, text: str = "text") -> DataFrame:
    """Fenced ranges by line number: first (opener), last (closer, or the last line of the text), closed.

    Only lines that can open or close a fence are folded, in the document's own row. ``strict_close`` asks
    that nothing follows a closer.
    """
    keep = [c for c in docs.columns if c != text]
    kind = "struct<first:int,last:int,closed:boolean>"
    none = F.array().cast(f"array<{kind}>")
    row = lambda first, last, closed: F.array(F.struct(first.alias("first"), last.alias("last"), F.lit(closed).alias("closed")))

    def ranges(lines: Column) -> Column:
        marked = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("no"), F.regexp_extract(x, FENCE, 1).alias("mark"), x.rlike(FENCE + r"[ \t\r]*$").alias("bare"))), lambda m: m["mark"] != "")

        def step(s: Column, m: Column) -> tuple[Column, Column]:
            closes = (s["no"] >= 0) & F.startswith(m["mark"], s["mark"]) & (m["bare"] | F.lit(not strict_close))
            shut, opened = (F.struct(no.alias("no"), mark.alias("mark")) for no, mark in ((F.lit(-1), F.lit("")), (m["no"], m["mark"])))
            return F.when(s["no"] < 0, opened).when(closes, shut).otherwise(s), F.when(closes, row(s["no"], m["no"], True)).otherwise(none)

        start = F.struct(F.lit(-1).alias("no"), F.lit("").alias("mark"))
        return fold(marked, start, kind, step, lambda s: F.when(s["no"] >= 0, row(s["no"], F.size(lines) - 1, False)).otherwise(none))

    return docs.select(*keep, F.explode(bind(F.split(F.col(text), "\n"), ranges)).alias("r")).select(*keep, "r.first", "r.last", "r.closed")


def with_protected(lines: DataFrame, ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with ``protected``: whether they lie in one of the ranges. Ranges of a document are few and join as one array."""
    by_doc = ranges.groupBy(key).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    joined = lines.join(by_doc, key, "left")
    return joined.withColumn("protected", F.coalesce(F.exists("ranges", lambda r: (F.col("line_no") >= r["first"]) & (F.col("line_no") <= r["last"])), F.lit(False))).drop("ranges")


def runs(df: DataFrame, keys: list[str], order: str, same: Column) -> DataFrame:
    """``run``: number of the maximal run of neighbouring rows with an equal value, from 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.coalesce(~same.eqNullSafe(F.lag(same).over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    return df.withColumn("run", F.sum(changed.cast("int")).over(w))


def indented_ranges(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Indented code outside fences: first and last line of each run that only blank lines interrupt."""
    free = lines.filter("NOT protected").withColumn("deep", F.col("line").rlike(r"^(?: {4}|\t)")).filter(F.col("deep") | (F.trim("line") != ""))
    numbered = runs(free, [key], "line_no", F.col("deep"))
    return numbered.filter("deep").groupBy(key, "run").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last")).drop("run")


HEADING = r"^(#{1,6})\s+(.+)$"


def block_kind(line: Column) -> Column:
    """heading, bullet, ordered, table, blank or paragraph, by the line alone."""
    return (
        F.when(F.trim(line) == "", "blank")
        .when(line.rlike(HEADING), "heading")
        .when(line.rlike(r"^\s*[-*]\s+.+$"), "bullet")
        .when(line.rlike(r"^\s*\d+[.)]\s+.+$"), "ordered")
        .when(line.rlike(r"^\s*\|.*\|\s*$"), "table")
        .otherwise("paragraph")
    )


def block_ranges(lines: Column) -> Column:
    """Blocks of a document's lines as (kind, first, last), in order.

    A fence is a block, unclosed up to the end. Paragraph and table lines go on while their kind stays; a paragraph line behind a list item
    belongs to it. Blank lines end what goes on.
    """
    kind = "struct<kind:string,first:int,last:int>"
    none = F.array().cast(f"array<{kind}>")
    carry = lambda mark, before, k, first, last: F.struct(mark.alias("mark"), before.alias("before"), k.alias("kind"), first.alias("first"), last.alias("last"))
    done = lambda s: F.when(s["kind"] != "", F.array(F.struct(s["kind"], s["first"], s["last"]))).otherwise(none)
    seen = F.transform(lines, lambda x, i: F.struct(i.alias("no"), F.regexp_extract(x, FENCE, 1).alias("mark"), block_kind(x).alias("kind")))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        inside = s["mark"] != ""
        opens = ~inside & (x["mark"] != "")
        now = F.when(inside | opens, F.lit("code")).otherwise(x["kind"])
        mark = F.when(opens, x["mark"]).when(inside & (x["mark"] != "") & F.startswith(x["mark"], s["mark"]), F.lit("")).otherwise(s["mark"])
        goes_on = inside | now.isin("paragraph", "table") & (now == s["before"]) | (now == "paragraph") & s["before"].isin("bullet", "ordered")
        new = carry(mark, now, F.when(goes_on, s["kind"]).otherwise(now), F.when(goes_on, s["first"]).otherwise(x["no"]), x["no"])
        blank = carry(s["mark"], F.lit("blank"), s["kind"], s["first"], s["last"])
        return F.when(now == "blank", blank).otherwise(new), F.when((now == "blank") | goes_on, none).otherwise(done(s))

    return fold(seen, carry(F.lit(""), F.lit(""), F.lit(""), F.lit(0), F.lit(0)), kind, step, done)


def extract_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_no, kind, level, first, text: code, headings, list items, tables and joined paragraphs in order.

    Blocks are found and cut out in the document's own row: no join, no shuffle.
    """
    def cut(lines: Column) -> Column:
        def block(b: Column) -> Column:
            own = F.slice(lines, b["first"] + 1, b["last"] - b["first"] + 1)
            joined = F.when(b["kind"].isin("code", "table"), F.array_join(own, "\n")).otherwise(F.array_join(F.transform(own, lambda x: F.trim(x)), " "))
            return F.struct(b["kind"].alias("kind"), b["first"].alias("first"), joined.alias("joined"))

        return F.transform(block_ranges(lines), block)

    found = docs.select("doc_id", F.posexplode(bind(F.split("text", "\n"), cut)).alias("at", "b")).select("doc_id", (F.col("at") + 1).cast("long").alias("block_no"), "b.*")
    joined = F.col("joined")
    bare = F.when(F.col("kind") == "heading", F.regexp_replace(joined, r"^#{1,6}\s+", "")).when(F.col("kind") == "bullet", F.regexp_replace(joined, r"^[-*]\s+", "")).when(F.col("kind") == "ordered", F.regexp_replace(joined, r"^\d+[.)]\s+", "")).otherwise(joined)
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(joined, r"^#+", 0)))
    return found.select("doc_id", "block_no", "kind", level.alias("level"), "first", bare.alias("text"))


def section_path(blocks: DataFrame, order: str = "block_no") -> DataFrame:
    """Blocks with ``section``: the titles above, shallow first. A heading's own title is included; skipped levels leave no hole."""
    w = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = {n: F.last(F.when(F.col("level") == n, F.struct(F.col(order).alias("at"), F.lower(F.trim("text")).alias("title"))), ignorenulls=True).over(w) for n in range(1, 7)}
    named = blocks.withColumns({f"h{n}": c for n, c in last.items()})
    path = []
    for n in range(1, 7):
        shallower = [F.col(f"h{k}.at") for k in range(1, n)]
        newest = F.greatest(F.lit(-1), F.lit(-1), *shallower) if shallower else F.lit(-1)
        path.append(F.when(F.col(f"h{n}.at") > newest, F.col(f"h{n}.title")))
    return named.withColumn("section", F.array_compact(F.array(*path))).drop(*(f"h{n}" for n in range(1, 7)))


def ordinals(nodes: DataFrame, order: str = "block_no") -> DataFrame:
    """``ordinal``: 0-based number of a node among those of its kind and section in the document."""
    w = Window.partitionBy("doc_id", "kind", "section").orderBy(order)
    return nodes.withColumn("ordinal", F.row_number().over(w) - 1)


def line_col(matches: DataFrame, lines: DataFrame) -> DataFrame:
    """Matches (doc_id, offset) with 1-based line and column, by the lines' offsets."""
    joined = matches.alias("m").join(lines.alias("l"), (F.col("m.doc_id") == F.col("l.doc_id")) & (F.col("m.offset") >= F.col("l.start")) & (F.col("m.offset") < F.col("l.stop")))
    return joined.select("m.*", (F.col("l.line_no") + 1).alias("line"), (F.col("m.offset") - F.col("l.start") + 1).alias("column"))


def outside_ranges(matches: DataFrame, ranges: DataFrame) -> DataFrame:
    """Matches (doc_id, line_no) that lie in none of the line ranges."""
    cond = (F.col("m.doc_id") == F.col("r.doc_id")) & (F.col("m.line_no") >= F.col("r.first")) & (F.col("m.line_no") <= F.col("r.last"))
    return matches.alias("m").join(ranges.alias("r"), cond, "left_anti")
