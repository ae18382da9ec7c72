"""Links of documents with the places of their destinations, resolved against an index and written back into the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.lines import bind, fold
from textloom.operators.links import resolve_links
from textloom.operators.segments import _pieces
from textloom.runtime import materialize

#: Fence lines, code spans and links; an image is none.
_MARK = r"(?m)^ {0,3}(?:`{3,}|~{3,})[^\n]*$|`+[^`\n]+`+|(?<!!)\[[^\]]+\]\([^)\s]+\)"
_ANY_LINK = r"(?<!!)\[[^\]]+\]\([^)\s]+\)"
_LINK = "struct<piece:int,start:int,line:int,column:int,label:string,url:string>"


def _links(pieces: Column) -> Column:
    """(piece, start, line, column, label, url) of each link outside fences; start is the destination's, from 0, line and column the link's, from 1."""
    none = F.array().cast(f"array<{_LINK}>")
    carry = lambda at, line, begins, mark: F.struct(at.alias("at"), line.alias("line"), begins.alias("begins"), mark.alias("mark"))
    seen = F.transform(pieces, lambda p, i: F.struct(p.alias("text"), i.alias("no"), F.length(p).alias("n"), (F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))).alias("ends"), (F.length(p) - F.length(F.substring_index(p, "\n", -1))).alias("last"), F.when(i % 2 == 1, F.regexp_extract(p, r"^ {0,3}(`{3,}|~{3,})", 1)).otherwise("").alias("fence"), ((i % 2 == 1) & F.startswith(p, F.lit("["))).alias("link")))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        closes = (s["mark"] != "") & F.startswith(x["fence"], s["mark"])
        mark = F.when(x["fence"] == "", s["mark"]).when(s["mark"] == "", x["fence"]).when(closes, "").otherwise(s["mark"])
        new = carry(s["at"] + x["n"], s["line"] + x["ends"], F.when(x["ends"] > 0, s["at"] + x["last"]).otherwise(s["begins"]), mark)
        split = F.instr(x["text"], "](")
        link = F.struct(x["no"].alias("piece"), (s["at"] + split + 1).alias("start"), s["line"].alias("line"), (s["at"] - s["begins"] + 1).alias("column"), F.substring(x["text"], F.lit(2), split - 2).alias("label"), F.substring(x["text"], split + 2, x["n"] - split - 2).alias("url"))
        return new, F.when(x["link"] & (s["mark"] == ""), F.array(link)).otherwise(none)

    return fold(seen, carry(F.lit(0), F.lit(1), F.lit(0), F.lit("")), _LINK, step)


def document_links(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, stop, line, column, label, url: links outside code in order; [start, stop) is the destination in the text."""
    some = docs.filter(F.regexp_like("text", F.lit(_ANY_LINK)))  # most texts without a link needn't be cut
    found = some.select("doc_id", F.explode(bind(_pieces(F.coalesce("text", F.lit("")), _MARK), _links)).alias("l")).select("doc_id", "l.*")
    return found.select("doc_id", "piece", "start", (F.col("start") + F.length("url")).alias("stop"), "line", "column", "label", "url")


def resolved_links(docs: DataFrame, index: DataFrame, aliases: DataFrame, public_base: str | None = None) -> DataFrame:
    """``document_links`` to other documents, with slug, source (index, public, ambiguous, unresolved) and resolved.

    A fragment goes along to the public site, the index has none. A link without a slug is unresolved.
    """
    links = materialize(document_links(docs).filter(T.is_relative_doc(F.col("url"))).withColumn("slug", T.link_slug(F.col("url"))), "found-links")
    found = resolve_links(links.filter("slug IS NOT NULL"), index, aliases, public_base)
    fragment = F.when(F.contains("url", F.lit("#")), F.concat(F.lit("#"), F.split_part("url", F.lit("#"), F.lit(2)))).otherwise("")
    found = found.withColumn("resolved", F.when(F.col("source") == "public", F.concat("resolved", fragment)).otherwise(F.col("resolved")))
    return found.unionByName(links.filter("slug IS NULL").withColumn("source", F.lit("unresolved")).withColumn("resolved", F.lit(None).cast("string")))


def rewrite_links(docs: DataFrame, index: DataFrame, aliases: DataFrame, public_base: str | None = None) -> DataFrame:
    """doc_id, text, blockers, warnings: each resolved destination in its place, all else as it was.

    Blockers are links that are ambiguous or unresolved, warnings those that only the public site has: ``code url line:column``, in order. Only links
    are joined; the texts meet one row for each document.
    """
    links = materialize(resolved_links(docs, index, aliases, public_base), "links")
    note = F.struct("piece", F.concat(F.when(F.col("source") == "public", "public-fallback").otherwise(F.concat("source", F.lit("-link"))), F.lit(" "), "url", F.lit(" "), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string")).alias("t"))
    listed = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, note))), lambda x: x["t"])
    per_doc = links.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("resolved").isNotNull(), F.struct("piece", F.struct("label", "resolved").alias("to"))))).alias("to"),
        listed(F.col("source").isin("ambiguous", "unresolved")).alias("blockers"), listed(F.col("source") == "public").alias("warnings"),
    )
    j = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(per_doc, "doc_id", "left")
    to = lambda i: F.try_element_at("to", i)
    written = bind(_pieces(F.col("text"), _MARK), lambda ps: F.array_join(F.transform(ps, lambda p, i: F.when(to(i).isNotNull(), F.concat(F.lit("["), to(i)["label"], F.lit("]("), to(i)["resolved"], F.lit(")"))).otherwise(p)), ""))
    none = F.array().cast("array<string>")
    return j.select("doc_id", F.when(F.col("to").isNull() | (F.size("to") == 0), F.col("text")).otherwise(written).alias("text"), F.coalesce("blockers", none).alias("blockers"), F.coalesce("warnings", none).alias("warnings"))


def link_drafts(docs: DataFrame, profile: str, known: list[str], index: DataFrame, aliases: DataFrame, public_base: str | None = None) -> DataFrame:
    """doc_id, draft, draft_hash, blockers, warnings: profile applied, links rewritten, canonical text. A document with blockers has no draft."""
    shown = materialize(docs.select("doc_id", T.filter_profile(F.col("text"), profile, known).alias("text")), "shown")
    linked = rewrite_links(shown, index, aliases, public_base)
    draft = F.when(F.size("blockers") == 0, T.canonical_markdown(F.col("text")))
    return linked.select("doc_id", draft.alias("draft"), "blockers", "warnings").select("doc_id", "draft", F.sha2("draft", 256).alias("draft_hash"), "blockers", "warnings")
