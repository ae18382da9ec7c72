"""Documents cut into segments by one scanner, and what the segments hold: tables, callouts, code, images, text.

A document's marks (fence lines, ``<table>`` and ``<div>`` tags) are found by one pattern and read once, text by text, in Arrow batches. The earliest mark that opens
something wins; what it opens ends at its own close, tags counted, whatever stands between. So a table in a table, a div in a div and tags in code
never end or begin anything outside. Segments are cut from the text as they end, in linear time.

Null texts are empty; an empty text has no segments. What stays open at the end is opaque.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.lines import bind, extract_blocks, ordinals, section_path

HTML = ("table", "div")


#: Before it a line begins, and after it no word goes on, as Java's patterns have it.
_LINE, _WORD_ENDS = r"(?:\A|(?<=[\n\x85\u2028\u2029])|(?<=\r)(?!\n))", r"(?![\w\u0300-\u036f])"
_BARE_FENCE = re.compile(r" *(?:`+|~+)[ \t\r]*\n?(?:\r\n|[\r\x85\u2028\u2029])?\Z")


def _tags(names: tuple[str, ...]) -> str:
    """Tags of these elements, ASCII letters in either case; the name is the pattern's group ``tag``."""
    either = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else re.escape(c) for c in name) for name in names)
    return rf"</?(?P<tag>{either}){_WORD_ENDS}[^>]*>"


def _pieces(text: Column, mark: str) -> Column:
    """What lies before, in, and between all marks, alternately: gap, mark, gap, ..., gap."""
    gaps, marks = F.split(text, mark, -1), F.regexp_extract_all(text, F.lit(mark), F.lit(0))
    return bind(F.struct(gaps.alias("g"), marks.alias("m")), lambda x: F.flatten(F.transform(x["g"], lambda g, i: F.when(i < F.size(x["m"]), F.array(g, F.get(x["m"], i))).otherwise(F.array(g)))))


def _class(tag: Column, name: str) -> Column:
    """Whether the tag has the class (a pattern)."""
    return F.regexp_like(tag, F.lit(rf"""(?is)\bclass\s*=\s*(?:"(?:[^"]*\s)?(?:{name})(?:\s[^"]*)?"|'(?:[^']*\s)?(?:{name})(?:\s[^']*)?')"""))


def _cut(text: str, mark: re.Pattern[str]) -> Iterator[tuple[str, str, str]]:
    """Segments of a text as (kind, head, content) in one pass: markdown, code, indented (a fence that deep), the elements' names, open- and a name."""
    what = own = head = ""  # what is open, by which fence or name
    depth = start = done = 0
    for m in mark.finditer(text):
        piece, fence, tag = m[0], m["fence"] or "", (m["tag"] or "").lower()
        deep, closing = len(piece) - len(piece.lstrip(" ")) >= 4, piece.startswith("</")
        alone = not fence and tag not in HTML and piece.endswith("/>")  # a component without a body
        if not what:
            if not closing and not alone:
                what, own, depth, start, head = ("indented" if deep else "code") if fence else tag, fence or tag, 1, m.start(), piece
            continue
        if what in ("code", "indented"):
            ends = fence.startswith(own) and deep == (what == "indented") and _BARE_FENCE.match(piece)
        else:
            depth += 0 if alone or tag != own else -1 if closing else 1
            ends = depth == 0
        if ends:
            if done < start:
                yield "markdown", "", text[done:start]
            yield what, head, text[start : m.end()]
            what, done = "", m.end()
    stop = start if what else len(text)
    if done < stop:
        yield "markdown", "", text[done:stop]
    if what:
        yield what if what in ("code", "indented") else f"open-{own}", head, text[start:]


def segments(docs: DataFrame, names: tuple[str, ...] = HTML) -> DataFrame:
    """doc_id, seg, kind, head, content: all of a text in order; ``head`` is the opening mark. Kinds: markdown, code, indented, table, callout, div, open-table, open-div.

    With other ``names`` their elements are the containers, and kinds are the names in lower case.
    """
    pattern = _LINE + r" *(?P<fence>`{3,}|~{3,})[^\n]*\n?|" + _tags(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = re.compile(pattern)
        for batch in batches:
            found = [(row, seg, *s) for row, text in enumerate(batch.column(1).to_pylist()) for seg, s in enumerate(_cut(text, mark))]
            row, *columns = zip(*found) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.string()] * 3)))], names=["doc_id", "seg", "kind", "head", "content"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, seg int, kind string, head string, content string")
    callout = _class(F.col("head"), "alert") & _class(F.col("head"), "note|warning")
    return found.withColumn("kind", F.when((F.col("kind") == "div") & callout, "callout").otherwise(F.col("kind")))


_ELEMENT = _tags(("table", "tr", "th", "td"))
_CELL = "struct<row:int,header:boolean,head:string,nested:boolean,html:string>"


def _cells(content: str, element: re.Pattern[str]) -> Iterator[tuple[int, bool, str, bool, str]]:
    """Cells of a table's own rows (row, header, head, nested, html). A cell ends at its close or where the next cell, row or the table's end stands."""
    depth, row, first, head, header, nested = 0, -1, -1, "", False, False
    for m in element.finditer(content):
        tag, closing = m["tag"].lower(), m[0].startswith("</")
        table, cell = tag == "table", tag in ("th", "td")
        above, depth = depth, depth + ((-1 if closing else 1) if table else 0)
        own = depth == 0 if table else above == 1  # marks of the table itself
        if own and first >= 0:
            yield row, header, head, nested, content[first : m.start()]
        row += own and tag == "tr" and not closing
        if own and cell and not closing:
            first, head, header, nested = m.end(), m[0], tag == "th", False
        else:
            first, nested = -1 if own else first, nested or (table and depth > 1)


def _with_cells(tables: DataFrame) -> DataFrame:
    """doc_id, seg, cells of tables (doc_id, seg, content)."""
    kind = pa.list_(pa.struct([("row", pa.int32()), ("header", pa.bool_()), ("head", pa.string()), ("nested", pa.bool_()), ("html", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        element = re.compile(_ELEMENT)
        for batch in batches:
            cells = [[dict(zip(("row", "header", "head", "nested", "html"), c)) for c in _cells(content, element)] for content in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, kind)], names=["doc_id", "seg", "cells"])

    return tables.select("doc_id", "seg", "content").mapInArrow(run, f"doc_id {tables.schema['doc_id'].dataType.simpleString()}, seg int, cells array<{_CELL}>")


def plain_cell(html: Column) -> Column:
    """A cell's visible text: tags out, the usual entities read, white space collapsed."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return T.normalize_ws(text)


def html_table_nodes(docs: DataFrame) -> DataFrame:
    """doc_id, seg, headers, rows (row_key, cells), issues: each HTML table outside code and containers; its first row has the headers.

    Issues, sorted: ``no-rows``, ``no-header-cells``, ``ragged``, ``empty-key``, ``duplicate-key:`` and the key, ``merged-cells`` (a span of several),
    ``nested-table``, ``relative-link``.
    """
    found = _with_cells(segments(docs).filter("kind = 'table'"))
    relative = F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["'](?!https?://|mailto:|#)""")
    span = F.lit(r"""(?i)\b(?:row|col)span\s*=\s*["']?(?!1\b)\d""")
    flag = lambda test, name: F.when(F.exists("cells", test), F.lit(name))
    flags = F.array(flag(lambda c: F.regexp_like(c["head"], span), "merged-cells"), flag(lambda c: c["nested"], "nested-table"), flag(lambda c: F.regexp_like(c["html"], relative), "relative-link"))
    by_row = F.transform(F.when(F.size("cells") > 0, F.sequence(F.lit(0), F.array_max(F.transform("cells", lambda c: c["row"])))).otherwise(F.array().cast("array<int>")), lambda r: F.transform(F.filter("cells", lambda c: c["row"] == r), lambda c: plain_cell(c["html"])))
    shaped = found.select("doc_id", "seg", flags.alias("flags"), by_row.alias("all"))
    shaped = shaped.select("doc_id", "seg", "flags", F.coalesce(F.get("all", F.lit(0)), F.array().cast("array<string>")).alias("headers"), F.transform(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), lambda r: F.struct(F.coalesce(F.get(r, F.lit(0)), F.lit("")).alias("row_key"), r.alias("cells"))).alias("rows"), F.size("all").alias("n"))
    keys = F.array_sort(F.transform("rows", lambda r: r["row_key"]))
    twice = F.array_distinct(F.filter(bind(keys, lambda k: F.transform(k, lambda x, i: F.when((x != "") & (x == F.get(k, i - 1)), x))), lambda x: x.isNotNull()))
    more = F.array(
        F.when(F.col("n") == 0, "no-rows"), F.when((F.col("n") > 0) & (F.size("headers") == 0), "no-header-cells"), F.when(F.exists("rows", lambda r: F.size(r["cells"]) != F.size("headers")), "ragged"),
        F.when(F.exists("rows", lambda r: r["row_key"] == ""), "empty-key"),
    )
    issues = F.array_sort(F.array_compact(F.concat("flags", more, F.transform(twice, lambda k: F.concat(F.lit("duplicate-key:"), k)))))
    return shaped.select("doc_id", "seg", "headers", "rows", issues.alias("issues"))


def _attribute(tag: Column, name: str) -> Column:
    """Its value, entities read; null without it."""
    both = rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    value = F.when(F.regexp_like(tag, F.lit(both)), F.concat(F.regexp_extract(tag, both, 1), F.regexp_extract(tag, both, 2)))
    for entity, sign in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(sign))
    return value


def component_admonitions(docs: DataFrame, name: str = "Admonition") -> DataFrame:
    """doc_id, seg, type, title, body, blocker: ``<Admonition type title>`` components outside code. Blockers: unclosed, nested, titled, in this order."""
    kind = name.lower()
    found = segments(docs, (name,)).filter(F.col("kind").isin(kind, f"open-{kind}"))
    body = T.trim_ws(F.regexp_replace(F.substring(F.col("content"), F.length("head") + 1, F.length("content")), rf"(?i)</{name}\s*>$", ""))
    title = _attribute(F.col("head"), "title")
    blocker = F.when(F.col("kind") != kind, "unclosed").when(F.regexp_like(body, F.lit(rf"(?i)<{name}\b")), "nested").when(F.coalesce(title, F.lit("")) != "", "titled")
    return found.select("doc_id", "seg", F.lower(F.coalesce(_attribute(F.col("head"), "type"), F.lit("note"))).alias("type"), title.alias("title"), body.alias("body"), blocker.alias("blocker"))


#: What a callout can't hold, by pattern.
CALLOUT_ISSUES = {
    "fenced-code": r"(?m)^\s*```", "table": r"(?m)^\s*\|.*\|\s*\n\s*\|?\s*:?-{3,}", "image": r"!\[[^\]]*\]\([^)]+\)", "nested": r"(?i)<(?:div|callout|table|img|whiteboard)\b",
    "nested-list": r"(?m)^(?: {2,}|\t)(?:[-*]|\d+[.)])\s+", "relative-link": r"(?<!!)\[[^\]]+\]\((?!\s*https?://)[^)]+\)", "quote": r"(?m)^\s*>", "checkbox": r"(?m)^\s*[-*]\s+\[[ xX]\]\s+", "divider": r"(?m)^\s*(?:-{3,}|\*{3,}|_{3,})\s*$",
}


def callout_nodes(docs: DataFrame, title_attribute: str = "data-title") -> DataFrame:
    """doc_id, seg, type, title (null if the div gives none), body, issues: each div of class ``alert`` and ``note`` or ``warning`` outside code and containers."""
    found = segments(docs).filter("kind = 'callout'")
    body = T.trim_ws(F.regexp_replace(F.expr("substring(content, length(head) + 1)"), r"(?i)</div\s*>$", ""))
    title = _attribute(F.col("head"), title_attribute)
    rows = found.select("doc_id", "seg", F.when(_class(F.col("head"), "note"), "note").otherwise("warning").alias("type"), title.alias("title"), body.alias("body"))
    issues = F.array_compact(F.array(*(F.when(F.regexp_like("body", F.lit(pattern)), name) for name, pattern in CALLOUT_ISSUES.items())))
    return rows.withColumn("issues", issues)


def callout_child_nodes(docs: DataFrame, title_attribute: str = "data-title") -> DataFrame:
    """doc_id, seg, ordinal, kind, text: the blocks inside each callout."""
    bodies = callout_nodes(docs, title_attribute).select(F.struct("doc_id", "seg").alias("doc_id"), F.col("body").alias("text"))
    return extract_blocks(bodies).select("doc_id.doc_id", "doc_id.seg", (F.col("block_no") - 1).alias("ordinal"), "kind", "text")


def drop_containers(docs: DataFrame, css: str, dedent: bool = True) -> DataFrame:
    """doc_id, text without the divs of class ``css`` outside code; fences that deep in lists move to the margin with what they hold."""
    own = F.when(F.col("kind").isin("div", "callout") & _class(F.col("head"), css), "").otherwise(F.col("content"))
    margin = F.regexp_extract("content", "^ *", 0)
    moved = F.when((F.col("kind") == "indented") & F.lit(dedent), F.array_join(F.transform(F.split("content", "\n", -1), lambda line: F.when(F.startswith(line, margin), F.substring(line, F.length(margin) + 1, F.length(line))).otherwise(F.ltrim(line))), "\n")).otherwise(own)
    gone = F.when(own == "", "").otherwise(moved)
    # the line end behind a dropped container goes too
    rows = segments(docs).select("doc_id", "seg", F.struct("seg", gone.alias("t"), (own == "").alias("gone")).alias("s"))
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    text = F.array_join(F.transform("s", lambda x, i: F.when((i > 0) & F.get("s", i - 1)["gone"], F.regexp_replace(x["t"], "^\n", "")).otherwise(x["t"])), "")
    return docs.select("doc_id").join(lists.select("doc_id", text.alias("text")), "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def local_nodes(docs: DataFrame) -> DataFrame:
    """doc_id, node_no, kind, block_type, section, ordinal, locator, content: the nodes of all kinds, in the order of the text.

    Frontmatter is opaque and stands first; code, tables, callouts and other containers are their segments; text between them becomes blocks: lone images are
    assets, lone component tags authoring-token, placeholders protected-resource, pipe tables table, the rest text. A section has the titles above, a heading's
    own too; ordinals count by kind and section.
    """
    clean = F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n"))
    front = r"(?s)^---\n.*?\n---(?:\n|$)"
    split = docs.select("doc_id", F.regexp_extract(clean, front, 0).alias("front"), F.regexp_replace(clean, front, "").alias("text"))
    none = F.lit(None).cast("int")
    head = split.filter("front <> ''").select("doc_id", F.lit(-1).alias("seg"), F.lit(0).cast("long").alias("block_no"), F.lit("opaque").alias("kind"), F.lit("frontmatter").alias("block_type"), none.alias("level"), F.col("front").alias("text"))
    parts = segments(split.select("doc_id", "text"))
    kinds = F.when(F.col("kind").isin("code", "table", "callout"), F.col("kind")).otherwise("opaque")
    whole = parts.filter("kind <> 'markdown'").select("doc_id", "seg", F.lit(0).cast("long").alias("block_no"), kinds.alias("kind"), F.col("kind").alias("block_type"), none.alias("level"), F.col("content").alias("text"))
    blocks = extract_blocks(parts.filter("kind = 'markdown'").select(F.struct("doc_id", "seg").alias("doc_id"), F.col("content").alias("text")))
    is_a = lambda pattern: F.regexp_like("text", F.lit(pattern))
    kind = (
        F.when(F.col("kind") == "table", "table").when(is_a(r"^!\[[^\]]*\]\([^)\s]+\)$"), "asset").when(is_a(r"^</?[A-Z][A-Za-z]*>$"), "authoring-token")
        .when(is_a(r"^<readonly-block\b[^>]*></readonly-block>$"), "protected-resource").otherwise("text")
    )
    texts = blocks.select("doc_id.doc_id", "doc_id.seg", "block_no", kind.alias("k"), F.col("kind").alias("block_type"), "level", "text").withColumnRenamed("k", "kind")
    every = head.unionByName(whole).unionByName(texts).withColumn("at", F.shiftleft((F.col("seg") + 1).cast("long"), 32) + F.col("block_no"))
    placed = ordinals(section_path(every.withColumn("level", F.when(F.col("kind") == "text", F.col("level"))), "at"), "at")
    locator = T.locator_key(F.col("kind"), F.col("section"), F.col("ordinal"))
    return placed.select("doc_id", "seg", "block_no", "kind", "block_type", "section", "ordinal", locator.alias("locator"), F.col("text").alias("content"))


def semantic_hashes(nodes: DataFrame, primary: str, secondary: str) -> DataFrame:
    """``local_nodes`` rows with ``hash``, by kind: text by block type and text with includes collapsed to the primary view, code by language and content without its
    fence, a callout by type, title and body, any other node whole."""
    content = F.col("content")
    fence = r"^ *(?:`{3,}|~{3,})"
    language = F.lower(F.regexp_extract(content, fence + r"[ \t]*([^\s`]*)", 1))
    inner = F.regexp_replace(F.regexp_replace(content, fence + r"[^\n]*\n?", ""), r"\n?" + fence[1:] + r"[ \t]*\n?$", "")
    head = F.regexp_extract(content, r"(?is)^<div\b[^>]*>", 0)
    body = T.trim_ws(F.regexp_replace(F.substring(content, F.length(head) + 1, F.length(content)), r"(?i)</div\s*>$", ""))
    said = (
        F.when(F.col("kind") == "text", F.concat_ws("|", F.lit("text"), "block_type", T.normalize_ws(T.collapse_includes(content, primary, secondary)))).when(F.col("kind") == "code", F.concat_ws("|", F.lit("code"), language, inner))
        .when(F.col("kind") == "callout", F.concat_ws("|", F.lit("callout"), F.when(_class(head, "note"), "note").otherwise("warning"), F.coalesce(_attribute(head, "data-title"), F.lit("")), body)).otherwise(F.concat_ws("|", "kind", content))
    )
    return nodes.withColumn("hash", F.sha2(said, 256))
