"""Constructs of a document as rows: code, images, links, tables, callouts, components, tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.lines import FENCE, explode_lines, fence_ranges, with_protected
from textloom.runtime import materialize, sized_broadcast

#: Aliases that may be broadcast.
MAX_BROADCAST_ALIASES = 100_000


def unprotected_lines(docs: DataFrame) -> DataFrame:
    """Lines outside fenced code."""
    return with_protected(explode_lines(docs), fence_ranges(docs)).filter("NOT protected").drop("protected")


def extract_code(docs: DataFrame) -> DataFrame:
    """Fenced blocks: first, last, closed, language, content, issues. The content is cut from the document's own lines."""
    ranges = fence_ranges(docs, strict_close=True)
    lines = docs.select("doc_id", F.split("text", "\n").alias("ls"))
    j = ranges.join(lines, "doc_id")
    n = F.when(F.col("closed"), F.col("last") - F.col("first") - 1).otherwise(F.col("last") - F.col("first"))
    content = F.array_join(F.slice("ls", F.col("first") + 2, n), "\n")
    info = F.trim(F.regexp_replace(F.get("ls", F.col("first")), FENCE, ""))
    issues = F.array_compact(F.array(F.when(~F.col("closed"), "unclosed"), F.when(F.contains(info, F.lit(" ")), "info-string"), F.when(content.rlike(r"(?m)^ {0,3}(?:`{3,}|~{3,})"), "nested")))
    return j.select("doc_id", "first", "last", "closed", F.lower(F.split_part(info, F.lit(" "), F.lit(1))).alias("language"), content.alias("content"), issues.alias("issues"))


def resolve_language(codes: DataFrame, aliases: DataFrame, known: list[str]) -> DataFrame:
    """Codes with ``resolved`` and ``issue``: aliases are followed to a known language, whatever the length of the chain.

    Null with issue ``cycle`` where a chain comes back to itself, with ``unsupported`` where it ends elsewhere.
    Chains double in length with every join of the alias table with itself, until none grows.
    """
    now = aliases.select(F.lower("alias").alias("a"), F.lower("target").alias("b")).distinct()
    size = now.count()
    for _ in range(size.bit_length() + 1):  # a chain has at most as many links as there are aliases
        after = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
        ends = F.col("b").isin(known) | F.col("c").isNull()
        now = materialize(now.join(after, "b", "left").select("a", F.when(ends, F.col("b")).otherwise(F.col("c")).alias("b")), "aliases")
    open_ = now.join(now.select(F.col("a").alias("b"), F.lit(True).alias("more")), "b", "left").select(F.col("a").alias("language"), F.when(F.col("b").isin(known), F.col("b")).alias("via"), F.coalesce("more", F.lit(False)).alias("more"))
    j = codes.join(sized_broadcast(open_, MAX_BROADCAST_ALIASES), "language", "left")
    resolved = F.when(F.col("language").isin(known), F.col("language")).otherwise(F.col("via"))
    issue = F.when(resolved.isNotNull(), None).when(F.col("more"), "cycle").when(F.coalesce("language", F.lit("")) != "", "unsupported")
    return j.select(*codes.columns, resolved.alias("resolved"), issue.alias("issue"))


def extract_images(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, alt, url, standalone: images outside code."""
    image = r"!\[([^\]]*)\]\(([^)\s]+)\)"
    found = unprotected_lines(docs).withColumn("m", F.explode(F.regexp_extract_all("line", F.lit(image), F.lit(0))))
    return found.select("doc_id", "line_no", F.regexp_extract("m", image, 1).alias("alt"), F.regexp_extract("m", image, 2).alias("url"), (F.trim("line") == F.col("m")).alias("standalone"))


def extract_links(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, occ, label, url: links (not images) outside code, in order."""
    link = r"(?<!!)\[([^\]]+)\]\(([^)\s]+)\)"
    found = unprotected_lines(docs).select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(link), F.lit(0))).alias("occ", "m"))
    return found.select("doc_id", "line_no", "occ", F.regexp_extract("m", link, 1).alias("label"), F.regexp_extract("m", link, 2).alias("url"))


#: Kinds of runs by the sign around them, in the order in which they are tried: a longer sign before one that begins it.
DELIMITERS = {"code": "`", "highlight": "==", "bold": "**", "italic": "*"}


def inline_pattern(delimiters: dict[str, str] = DELIMITERS) -> str:
    """One alternative for a backslash and what it escapes, for each pair of signs and for a link. Inside a pair its sign doesn't occur unescaped."""
    def pair(sign: str) -> str:
        s = re.escape(sign)
        inner = r"(?:\\.|[^\\" + re.escape(sign[0]) + "])" if sign != "`" else "[^`]"  # code has no escapes
        return f"{s}{inner}+{s}"

    return "|".join([r"\\[\\`*=\[\]()]", *map(pair, delimiters.values()), r"\[(?:\\.|[^\\\]])+\]\([^)]+\)"])


def inline_runs(lines: DataFrame, line: str = "line", delimiters: dict[str, str] = DELIMITERS) -> DataFrame:
    """Runs of a line in order: pos, kind (text, a delimiter's kind or link), value, url. An escaped sign is text.

    The line is cut at the marked places; each is read by the sign that it begins with.
    """
    pattern = inline_pattern(delimiters)
    marked, gaps = F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), F.split(line, pattern)
    run = lambda kind, value, url=None: F.struct(F.lit(kind).alias("kind"), value.alias("value"), (F.lit(None) if url is None else url).cast("string").alias("url"))

    def read(m: Column) -> Column:
        label_end = F.instr(m, "](")
        out = run("link", F.substring(m, F.lit(2), label_end - 2), T.normalize_link(F.substring(m, label_end + 2, F.length(m) - label_end - 2)))
        for kind, sign in reversed(delimiters.items()):
            out = F.when(F.startswith(m, F.lit(sign)), run(kind, F.substring(m, F.lit(len(sign) + 1), F.length(m) - 2 * len(sign)))).otherwise(out)
        return F.when(F.startswith(m, F.lit("\\")), run("text", F.substring(m, 2, 1))).otherwise(out)

    parts = F.flatten(F.transform(gaps, lambda g, i: F.array_compact(F.array(run("text", g), F.get(F.transform(marked, read), i)))))
    others = [c for c in lines.columns if c != line]
    return lines.select(*others, F.posexplode(F.filter(parts, lambda r: r["value"] != "")).alias("pos", "r")).select(*others, "pos", "r.kind", "r.value", "r.url")


def pipe_cells(line: Column) -> Column:
    """Cells of a table line; escaped pipes and pipes in code don't part cells."""
    inner = F.regexp_replace(T.trim_ws(line), r"^\||(?<!\\)\|$", "")
    masked = F.replace(inner, F.lit("\\|"), F.lit("\x01"))
    in_code = F.array_join(F.transform(F.split(masked, "`"), lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit("|"), F.lit("\x01"))).otherwise(p)), "`")
    return F.transform(F.split(in_code, r"\|"), lambda c: F.replace(T.trim_ws(c), F.lit("\x01"), F.lit("|")))


def pipe_tables(blocks: DataFrame) -> DataFrame:
    """Rows of pipe tables (blocks of kind table): doc_id, block_no, row_no (0 is the header), cells padded to the widest row."""
    lines = F.split("text", "\n")
    separator = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"
    good = blocks.filter("kind = 'table'").filter(F.coalesce(F.get(lines, F.lit(1)), F.lit("")).rlike(separator))
    rows = F.transform(F.filter(lines, lambda x, i: i != 1), pipe_cells)
    width = F.array_max(F.transform(rows, F.size))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    return good.select("doc_id", "block_no", F.posexplode(padded).alias("row_no", "cells"))


def html_tables(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, table_no, row_no, row_key, cells, issues of flat HTML tables. Spans, nesting and empty keys are issues."""
    tables = docs.select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit(r"(?is)<table\b[^>]*>.*?</table>"), F.lit(0))).alias("table_no", "t"))
    flags = F.array_compact(F.array(F.when(F.col("t").rlike(r"(?i)\b(?:row|col)span\s*="), "span"), F.when(F.size(F.regexp_extract_all("t", F.lit("(?i)<table"), F.lit(0))) > 1, "nested")))
    rows = tables.select("doc_id", "table_no", flags.alias("flags"), F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), lambda c: T.normalize_ws(F.regexp_replace(c, "<[^>]+>", "")))
    out = rows.select("doc_id", "table_no", "row_no", "flags", cells.alias("cells")).withColumn("row_key", F.get("cells", F.lit(0)))
    w = Window.partitionBy("doc_id", "table_no", "row_key")
    twice = F.count(F.lit(1)).over(w) > 1
    ragged = F.size("cells") != F.max(F.size("cells")).over(Window.partitionBy("doc_id", "table_no"))
    issues = F.concat("flags", F.array_compact(F.array(F.when(F.coalesce("row_key", F.lit("")) == "", "empty-key"), F.when(twice, "duplicate-key"), F.when(ragged, "ragged"))))
    return out.select("doc_id", "table_no", "row_no", "row_key", "cells", issues.alias("issues"))


def admonitions(docs: DataFrame) -> DataFrame:
    """``:::type`` blocks: doc_id, first, last, type, title, content, blocker (unclosed or nested)."""
    marks = unprotected_lines(docs).filter(F.col("line").rlike(r"^\s*:::"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    opens = F.col("line").rlike(r"^\s*:::\s*[A-Za-z]")
    seen = marks.withColumn("opens", opens).withColumn("next_no", F.lead("line_no").over(w)).withColumn("next_opens", F.lead(opens).over(w)).filter("opens")
    lines = docs.select("doc_id", F.split("text", "\n").alias("ls"))
    closed = F.col("next_no").isNotNull() & ~F.coalesce("next_opens", F.lit(True))
    content = F.when(closed, F.array_join(F.slice("ls", F.col("line_no") + 2, F.col("next_no") - F.col("line_no") - 1), "\n"))
    head = r"^\s*:::\s*([A-Za-z]+)\s*(.*)$"
    blocker = F.when(F.col("next_no").isNull(), "unclosed").when(F.col("next_opens"), "nested")
    return seen.join(lines, "doc_id").select("doc_id", F.col("line_no").alias("first"), F.when(closed, F.col("next_no")).alias("last"), F.lower(F.regexp_extract("line", head, 1)).alias("type"), F.trim(F.regexp_extract("line", head, 2)).alias("title"), content.alias("content"), blocker.alias("blocker"))


def div_callouts(docs: DataFrame) -> DataFrame:
    """``<div class="alert …">`` blocks: doc_id, occ, type, body, issues."""
    block = r"(?is)<div\s+class=[\"'][^\"']*\balert\b\s*(\w+)?[^\"']*[\"']\s*>(.*?)</div>"
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(block), F.lit(0))).alias("occ", "m"))
    body = F.regexp_extract("m", block, 2)
    issues = F.array_compact(F.array(F.when(body.rlike("(?i)<div"), "nested"), F.when(body.rlike("(?i)<table"), "table"), F.when(F.trim(body) == "", "empty")))
    return found.select("doc_id", "occ", F.lower(F.regexp_extract("m", block, 1)).alias("type"), T.trim_ws(body).alias("body"), issues.alias("issues"))


#: Constructs that a plain dialect has no place for.
UNSUPPORTED = {"import": r"^import\s+.+\s+from\s+[\"']", "component": r"^\s*</?[A-Z][A-Za-z]*\b", "directive": r"^\s*:::", "expression": r"\{\{[^}]*\}\}"}


def find_unsupported(docs: DataFrame, kinds: dict[str, str] = UNSUPPORTED) -> DataFrame:
    """doc_id, line (1-based), column, code: every place of each construct, outside code.

    A match's column is what lies before it: the lengths of the gaps and matches so far.
    """
    lines = unprotected_lines(docs)

    def places(code: str, pattern: str) -> Column:
        found, gaps = F.regexp_extract_all("line", F.lit(pattern), F.lit(0)), F.split("line", pattern)
        before = lambda i: F.aggregate(F.slice(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))), F.lit(1), i), F.lit(0), lambda a, x: a + x)
        return F.transform(found, lambda m, i: F.struct(F.lit(code).alias("code"), (before(i) + F.length(F.get(gaps, i)) + 1).alias("column")))

    hits = F.concat(*(F.when(F.col("line").rlike(p), places(k, p)).otherwise(F.array().cast("array<struct<code:string,column:int>>")) for k, p in kinds.items()))
    return lines.select("doc_id", "line_no", F.explode(hits).alias("h")).select("doc_id", (F.col("line_no") + 1).alias("line"), "h.column", "h.code")


def component_tokens(docs: DataFrame, name: str) -> DataFrame:
    """Opening and closing tags of a component that stand alone in a line: doc_id, line_no, step (1, -1)."""
    lines = unprotected_lines(docs)
    step = F.when(F.trim("line") == f"<{name}>", 1).when(F.trim("line") == f"</{name}>", -1)
    return lines.select("doc_id", "line_no", step.alias("step")).filter("step is not null")


def component_inventory(docs: DataFrame, known: list[str]) -> DataFrame:
    """doc_id, name, status, n: components and directives by name."""
    lines = unprotected_lines(docs)
    tags = F.regexp_extract_all("line", F.lit(r"</?([A-Z][A-Za-z]*)\b"), F.lit(1))
    marks = F.transform(F.regexp_extract_all("line", F.lit(r"^\s*:::\s*([A-Za-z]+)"), F.lit(1)), lambda m: F.concat(F.lit(":::"), m))
    names = lines.select("doc_id", F.explode(F.concat(tags, marks)).alias("name"))
    return names.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n")).withColumn("status", F.when(F.col("name").isin(known), "known").otherwise("unknown"))


def substitute_variables(docs: DataFrame, variables: DataFrame) -> DataFrame:
    """``{{name}}`` replaced by its value (name, value); missing names stay and are listed.

    References are joined as rows and come back as one map per document, with which its text is rebuilt.
    """
    ref = r"\{\{\s*([\w.-]+)\s*\}\}"
    names = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ref), F.lit(1)))).alias("name"))
    found = names.join(variables.select("name", "value"), "name", "left").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("name", "value")))).alias("vars"), F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.col("name")))).alias("missing"))
    j = docs.join(found, "doc_id", "left")
    refs, gaps = F.regexp_extract_all("text", F.lit(ref), F.lit(0)), F.split("text", ref)
    value = lambda r: F.coalesce(F.try_element_at(F.coalesce("vars", F.create_map().cast("map<string,string>")), F.regexp_extract(r, ref, 1)), r)
    filled = F.transform(refs, value)
    text = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(filled, i), F.lit("")))), "")
    return j.select("doc_id", text.alias("text"), F.coalesce(F.array_join("missing", ","), F.lit("")).alias("missing"))
