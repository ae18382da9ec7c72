"""Product wording by sentences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.lines import bind, fold


@dataclass(frozen=True)
class Wording:
    """A product's name (a pattern), how a version of it is named (a pattern), its profile, and the other profile with its name."""

    mention: str
    versioned: str
    target: str
    name: str
    other_target: str
    other_name: str


#: What a rewrite leaves alone: include and exclude spans, inline code, links.
PROTECTED = r"(?s)<(include|exclude)\b.*?</\1>|`[^`]*`|\[[^\]]+\]\([^)]+\)"
_HELD = "\x00"


def _sentences(line: Column, rules: list[Wording]) -> Column:
    def one(part: Column) -> Column:
        blank = F.regexp_extract(part, r"^\s*", 0)
        body = F.substring(part, F.length(blank) + 1, F.length(part))
        for rule in rules:
            dual = f'<include target="{rule.target}">{rule.name}</include><include target="{rule.other_target}">{rule.other_name}</include>'
            wrapped = F.concat(F.lit(f'<include target="{rule.target}">'), body, F.lit("</include>"))
            # a sentence that a rule has written is no other rule's
            body = F.when(F.contains(body, F.lit("<include ")), body).when(F.regexp_like(body, F.lit(rule.versioned)), wrapped).otherwise(F.regexp_replace(body, rule.mention, dual))
        return F.concat(blank, body)

    return F.array_join(F.transform(F.split(line, r"(?<=[.!?])(?=\s)", -1), one), "")


def rewrite_wording(docs: DataFrame, rules: list[Wording]) -> DataFrame:
    """doc_id, text, warnings: product names by the rules, in order.

    A sentence that names a version is only for that product; other mentions become a pair of names. Code, headings and protected spans stay; a heading with a
    mention is a warning. Sentences end at ``.``, ``!`` or ``?`` before white space or at the line's end.
    """
    def restored(line: Column) -> Column:
        held = F.regexp_extract_all(line, F.lit(PROTECTED), F.lit(0))
        gaps = F.split(_sentences(F.regexp_replace(F.translate(line, _HELD, ""), PROTECTED, _HELD), rules), _HELD, -1)
        return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(held, i), F.lit("")))), "")

    def whole(lines: Column) -> Column:
        row = lambda kind, line: F.array(F.struct(kind.alias("kind"), line.alias("line")))

        def step(inside: Column, line: Column) -> tuple[Column, Column]:
            fence = F.startswith(F.ltrim(line), F.lit("```"))
            kind = F.when(fence | inside, "code").when(F.regexp_like(line, F.lit(r"^#{1,6}\s+")), "heading").otherwise("text")
            return F.when(fence, ~inside).otherwise(inside), row(kind, line)

        return fold(lines, F.lit(False), "struct<kind:string,line:string>", step)

    lines = bind(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1), whole)
    text = lambda ls: F.array_join(F.transform(ls, lambda x: F.when(x["kind"] == "text", restored(x["line"])).otherwise(x["line"])), "\n")
    named = "|".join(f"(?:{r.mention})" for r in rules)
    warned = lambda ls: F.transform(F.filter(ls, lambda x: (x["kind"] == "heading") & F.regexp_like(x["line"], F.lit(named))), lambda x: x["line"])
    return docs.select("doc_id", bind(lines, lambda ls: F.struct(text(ls).alias("text"), warned(ls).alias("warnings"))).alias("r")).select("doc_id", "r.*")
