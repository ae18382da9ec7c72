"""Authoring transforms: wording by profile, markup and links kept from a counterpart, fences, callouts, fragments, assets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.extract import extract_links
from textloom.operators.lines import explode_lines, fence_ranges, with_protected
from textloom.runtime import materialize


def rewrite_product(docs: DataFrame, plain: str, dual: str) -> DataFrame:
    """Every whole word ``plain`` outside code, links, tags and headings becomes ``dual``. Headings with the word are counted as warnings.

    Lines are rewritten where they lie and joined again by document in their order.
    """
    lines = with_protected(explode_lines(docs), fence_ranges(docs))
    guarded = r"`[^`]+`|\[[^\]]*\]\([^)]*\)|<[^>]+>"
    keep, gaps = F.regexp_extract_all("line", F.lit(guarded), F.lit(0)), F.split("line", guarded)
    word = rf"(?<![\w-]){plain}(?![\w-])"
    new = F.array_join(F.transform(gaps, lambda g, i: F.concat(F.regexp_replace(g, word, dual), F.coalesce(F.get(keep, i), F.lit("")))), "")
    heading = F.startswith("line", F.lit("#"))
    out = lines.select("doc_id", "line_no", F.when(F.col("protected") | heading, F.col("line")).otherwise(new).alias("line"), (heading & ~F.col("protected") & F.col("line").rlike(word)).alias("warns"))
    return out.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"), F.count_if("warns").alias("warnings"))


def restore_includes(pairs: DataFrame) -> DataFrame:
    """(doc_id, local, remote) to local text in which text that the remote has inside include markup gets that markup again.

    Only text that occurs in the local document as often as the remote marks it. A visible text is one
    replacement; replacements are folded over the document's own short list, in the order of first appearance.
    """
    span = r"(?s)<include\s+target=\"[^\"]*\">(.*?)</include>"
    raws = F.regexp_extract_all("remote", F.lit(span), F.lit(0))
    marked = F.transform(raws, lambda r: F.struct(F.regexp_extract(r, span, 1).alias("visible"), r.alias("raw")))
    once = F.filter(marked, lambda m, i: (m["visible"] != "") & ~F.exists(F.slice(marked, F.lit(1), i), lambda e: e["visible"] == m["visible"]))
    n_marked = lambda m: F.size(F.filter(marked, lambda e: e["visible"] == m["visible"]))
    n_there = lambda t, m: F.floor((F.length(t) - F.length(F.replace(t, m["visible"], F.lit("")))) / F.length(m["visible"])).cast("int")
    out = F.aggregate(once, F.col("local"), lambda t, m: F.when(n_there(t, m) == n_marked(m), F.replace(t, m["visible"], m["raw"])).otherwise(t))
    return pairs.select("doc_id", F.when(F.col("local").rlike(r"(?i)<include\b"), F.col("local")).otherwise(out).alias("text"))


def restore_links(local: DataFrame, remote: DataFrame, host: str) -> DataFrame:
    """Local links on ``host`` (doc_id, line_no, occ, label, url) with the remote's destination of the same label and page.

    Only where both sides have the pair equally often; the nth local one takes the nth remote one.
    """
    def keyed(df: DataFrame) -> DataFrame:
        page = F.split_part("url", F.lit("#"), F.lit(1))
        links = extract_links(df).filter(F.col("url").rlike(rf"^https?://(?:[A-Za-z0-9-]+\.)*{host}(?:/|$)")).withColumn("page", page)
        w = Window.partitionBy("doc_id", "label", "page")
        return links.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("nth", F.row_number().over(w.orderBy("line_no", "occ")))

    a, b = keyed(local), keyed(remote).select("doc_id", "label", "page", "n", "nth", F.col("url").alias("remote_url"))
    return a.join(b, ["doc_id", "label", "page", "n", "nth"], "left").select("doc_id", "line_no", "occ", "label", F.coalesce("remote_url", "url").alias("url"))


def strip_heading_anchors(docs: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line), headings outside code without their anchors."""
    lines = with_protected(explode_lines(docs), fence_ranges(docs))
    return lines.select("doc_id", "line_no", F.when(F.col("protected"), F.col("line")).otherwise(T.strip_heading_anchor(F.col("line"))).alias("line"))


def canonical_fences(docs: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Languages after fence openers by their canonical names; the rest of the text as it is."""
    lines = explode_lines(docs).join(fence_ranges(docs).select("doc_id", F.col("first").alias("line_no"), F.lit(True).alias("opens")), ["doc_id", "line_no"], "left")
    info = F.lower(F.regexp_extract("line", r"^ {0,3}(?:`{3,}|~{3,})\s*(\S*)", 1))
    name = reduce(lambda other, kv: F.when(info == kv[0], kv[1]).otherwise(other), aliases.items(), info)
    new = F.concat(F.regexp_extract("line", r"^ {0,3}(?:`{3,}|~{3,})", 0), name, F.regexp_replace("line", r"^ {0,3}(?:`{3,}|~{3,})\s*\S*", ""))
    out = lines.select("doc_id", "line_no", F.when(F.col("opens"), new).otherwise(F.col("line")).alias("line"))
    return out.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def canonical_callouts(docs: DataFrame, known: list[str]) -> DataFrame:
    """``<callout type="…">…</callout>`` as a quoted note; unknown types and nesting are listed as issues and stay."""
    span = r"(?s)<callout\s+type=\"([^\"]*)\">(.*?)</callout>"
    spans, gaps = F.regexp_extract_all("text", F.lit(span), F.lit(0)), F.split("text", span)
    kind, body = (lambda s: F.lower(F.regexp_extract(s, span, 1))), (lambda s: T.trim_ws(F.regexp_extract(s, span, 2)))
    bad = lambda s: F.when(F.contains(body(s), F.lit("<callout")), "nested").when(~kind(s).isin(known), "unknown-type")
    shown = F.transform(spans, lambda s: F.when(bad(s).isNotNull(), s).otherwise(F.concat(F.lit("> **"), kind(s), F.lit("**\n> "), F.replace(body(s), F.lit("\n"), F.lit("\n> ")))))
    text = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(shown, i), F.lit("")))), "")
    return docs.select("doc_id", text.alias("text"), F.array_join(F.array_compact(F.transform(spans, bad)), ",").alias("issues"))


def expand_fragments(docs: DataFrame, fragments: DataFrame) -> DataFrame:
    """``{{> name}}`` references replaced by fragments (name, text), fragments inside fragments too.

    Fragments are expanded among themselves first, depth by depth, each pass joining one level of references,
    until no fragment becomes ready; then documents once. A reference that stays is listed with the reason,
    ``missing``, ``escaping`` (it leaves the folder of fragments) or ``cycle``, and the way there, by each fragment's first reference
    that stays: ``a:missing a > b > gone``.
    """
    ref = r"\{\{>\s*([\w./-]+)\s*\}\}"

    def once(df: DataFrame, key: str, parts: DataFrame) -> DataFrame:
        names = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ref), F.lit(1)))).alias("ref"))
        found = names.join(parts.select(F.col("name").alias("ref"), F.col("text").alias("part")), "ref").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("ref", "part"))).alias("parts"))
        refs, gaps = F.regexp_extract_all("text", F.lit(ref), F.lit(0)), F.split("text", ref)
        parts_map = F.coalesce("parts", F.create_map().cast("map<string,string>"))
        filled = F.transform(refs, lambda r: F.coalesce(F.try_element_at(parts_map, F.regexp_extract(r, ref, 1)), r))
        text = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(filled, i), F.lit("")))), "")
        return df.join(found, key, "left").select(key, text.alias("text"))

    has_ref = F.col("text").rlike(ref)
    closed = materialize(fragments.filter(~has_ref).select("name", "text"), "fragments")
    open_ = materialize(fragments.filter(has_ref).select("name", "text"), "fragments")
    while not open_.isEmpty():
        # only fragments whose every reference is closed are filled in: a cycle never is
        wants = open_.select(F.col("name").alias("of"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ref), F.lit(1)))).alias("name"))
        blocked = wants.join(closed.select("name"), "name", "left_anti").select(F.col("of").alias("name")).distinct()
        ready = materialize(open_.join(blocked, "name", "left_anti"), "fragments")
        if ready.isEmpty():  # the rest wait for each other or for missing ones
            break
        closed = materialize(closed.unionByName(once(ready, "name", closed)), "fragments")
        open_ = materialize(open_.join(closed.select("name"), "name", "left_anti"), "fragments")
    out = once(docs, "doc_id", closed)
    left = out.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ref), F.lit(1)))).alias("name"))
    # of a fragment that stays, the first reference that isn't closed tells what is wrong; such pointers end at a missing one or come back
    stuck = materialize(open_.select("name", F.posexplode(F.regexp_extract_all("text", F.lit(ref), F.lit(1))).alias("at", "ref")).join(closed.select(F.col("name").alias("ref")), "ref", "left_anti").groupBy("name").agg(F.min_by("ref", "at").alias("next")), "fragments")
    way = materialize(left.select("name").distinct().select("name", F.array("name").alias("way"), F.col("name").alias("next_name")), "fragments")
    ends = []
    while not way.isEmpty():
        step = way.join(stuck.select(F.col("name").alias("next_name"), "next"), "next_name", "left")
        stays = F.col("next").isNull()
        back = F.array_contains("way", F.col("next"))
        last = F.col("next_name")
        reason = F.when(back, "cycle").when(last.rlike(r"(?:^|/)\.\.(?:/|$)|^/"), "escaping").otherwise("missing")
        step = materialize(step.select("name", F.when(stays, F.col("way")).otherwise(F.concat("way", F.array("next"))).alias("way"), F.when(stays | back, reason).alias("reason"), F.coalesce("next", last).alias("next_name")), "fragments")
        ends.append(step.filter("reason IS NOT NULL").select("name", "reason", "way"))
        way = step.filter("reason IS NULL").drop("reason")
    reasons = reduce(DataFrame.unionByName, ends) if ends else left.select("name", F.lit("").alias("reason"), F.array("name").alias("way"))
    chain = F.when(F.size("way") > 1, F.concat(F.lit(" "), F.array_join("way", " > "))).otherwise("")
    named = left.join(reasons, "name").select("doc_id", F.concat("name", F.lit(":"), "reason", chain).alias("issue"))
    issues = named.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("issue")), ",").alias("unresolved"))
    return out.join(issues, "doc_id", "left").select("doc_id", "text", F.coalesce("unresolved", F.lit("")).alias("unresolved"))


def block_hash(blocks: DataFrame, volatile: tuple[str, ...] = ("block_id", "parent_id")) -> DataFrame:
    """(block_id, hash) over a block's runs (pos, style, content), neighbours of one style merged, ids left out."""
    w = Window.partitionBy("block_id").orderBy("pos")
    changed = F.coalesce(F.lag("style").over(w) != F.col("style"), F.lit(True))
    runs = blocks.withColumn("run", F.sum(changed.cast("int")).over(w)).groupBy("block_id", "run").agg(F.min("style").alias("style"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "").alias("content"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("run", "style", "content"))), lambda x: F.concat_ws(":", x["style"], x["content"]))
    return runs.groupBy("block_id").agg(F.sha2(F.array_join(line, "|"), 256).alias("hash"))


def node_hash(kind: Column, text: Column, language: Column) -> Column:
    """Hash by kind: code by content and language, text by its canonical form, others whole."""
    body = F.when(kind == "code", F.concat_ws("|", F.lit("code"), text, F.coalesce(language, F.lit("")))).when(kind.isin("paragraph", "heading", "bullet", "ordered"), F.concat_ws("|", F.lit("text"), kind, T.normalize_ws(text))).otherwise(F.concat_ws("|", kind, text))
    return F.sha2(body, 256)


def cells_equiv(a: Column, b: Column, ignore_bold: bool = False) -> Column:
    """Whether two cells mean the same: blanks collapsed, empty tail dropped, bold ignored if asked."""
    clean = lambda c: T.normalize_ws(F.regexp_replace(c, r"\*\*", "") if ignore_bold else c)
    return clean(a).eqNullSafe(clean(b))


def block_tables(cells: DataFrame, width: Column) -> DataFrame:
    """Tables from cells (table_key, n, content) in reading order: row_no, col_no, content."""
    return cells.select("table_key", F.floor(F.col("n") / width).cast("long").alias("row_no"), F.pmod(F.col("n"), width).cast("long").alias("col_no"), "content")


def addon_resources(blocks: DataFrame, payload: str, type_id: str) -> DataFrame:
    """Blocks of one add-on type with name and id of their record, itself JSON text inside the payload."""
    v = F.try_parse_json(payload)
    record = F.try_parse_json(F.try_variant_get(v, "$.record", "string"))
    rows = blocks.withColumn("type", F.try_variant_get(v, "$.type", "string")).filter(F.col("type") == type_id)
    return rows.select("block_id", F.try_variant_get(record, "$.name", "string").alias("name"), F.try_variant_get(record, "$.id", "int").alias("record_id"))


def clean_selectors(docs: DataFrame, css: str) -> DataFrame:
    """Texts without ``<div class="css">…</div>`` blocks."""
    return docs.select("doc_id", F.regexp_replace("text", rf"(?is)<div\s+class=[\"'][^\"']*\b{css}\b[^\"']*[\"']\s*>.*?</div>\n?", "").alias("text"))


def svg_audit(assets: DataFrame, allowed: list[str]) -> DataFrame:
    """(asset, issue) of SVG texts: element not allowed, outside reference, event attribute, no viewBox."""
    tags = F.array_distinct(F.transform(F.regexp_extract_all("svg", F.lit(r"<([A-Za-z][\w:-]*)"), F.lit(1)), lambda t: F.lower(t)))
    strange = F.filter(tags, lambda t: ~t.isin(allowed))
    issues = F.array_compact(F.concat(F.transform(strange, lambda t: F.concat(F.lit("element:"), t)), F.array(
        F.when(F.col("svg").rlike(r"(?i)\b(?:xlink:)?href\s*=\s*[\"'](?!#)"), "external-reference"), F.when(F.col("svg").rlike(r"(?i)\son\w+\s*="), "event-attribute"), F.when(~F.col("svg").rlike(r"(?i)<svg\b[^>]*\bviewBox="), "no-viewbox"))))
    return assets.select("asset", F.explode(issues).alias("issue"))


def board_hash(nodes: DataFrame, texts: list[str]) -> DataFrame:
    """Per board a hash of its nodes by id, and whether every required text is on it."""
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "content"))), lambda x: F.concat_ws(":", x["node_id"].cast("string"), x["content"])), "|")
    return nodes.groupBy("board").agg(F.sha2(shown, 256).alias("hash"), reduce(lambda a, b: a & b, (F.bool_or(F.contains("content", F.lit(t))) for t in texts)).alias("complete"))


def discover_assets(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images (doc_id, url, standalone) with the state of their pair of files (asset): paired, no-source, no-image, missing, inline."""
    key = T.asset_key(F.regexp_replace("url", r"\.(?:png|svg)$", ""))
    have = lambda ext: files.filter(F.endswith("asset", F.lit(ext))).select(F.regexp_replace("asset", r"\.(?:png|svg)$", "").alias("key"), F.lit(True).alias(ext[1:])).distinct()
    j = images.withColumn("key", key).join(have(".png"), "key", "left").join(have(".svg"), "key", "left")
    png, svg = F.col("png").isNotNull(), F.col("svg").isNotNull()
    return j.select("doc_id", "url", F.when(~F.col("standalone"), "inline").when(png & svg, "paired").when(png, "no-source").when(svg, "no-image").otherwise("missing").alias("state"))


def carry_aliases(base: DataFrame, local: DataFrame, remote: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Code at one place in three versions (doc_id, first, language): the local alias stays if all resolve to one language."""
    canon = lambda c: reduce(lambda other, kv: F.when(c == kv[0], kv[1]).otherwise(other), aliases.items(), c)
    side = lambda df, n: df.select("doc_id", "first", F.col("language").alias(n))
    j = side(base, "b").join(side(local, "l"), ["doc_id", "first"]).join(side(remote, "r"), ["doc_id", "first"])
    same = (canon(F.col("b")) == canon(F.col("l"))) & (canon(F.col("l")) == canon(F.col("r")))
    return j.select("doc_id", "first", F.when(same, F.col("l")).otherwise(F.col("r")).alias("language"))


def build_drafts(docs: DataFrame, profile: str, known: list[str], primary: str, secondary: str) -> DataFrame:
    """Publish drafts: profile applied, canonical text, its hash."""
    text = T.canonical_markdown(T.filter_profile(F.col("text"), profile, known))
    return docs.select("doc_id", text.alias("draft")).select("doc_id", "draft", F.sha2("draft", 256).alias("draft_hash"), F.sha2(T.collapse_includes(F.col("draft"), primary, secondary), 256).alias("view_hash"))


def build_pulls(docs: DataFrame, callouts: list[str], aliases: dict[str, str], profile: str, known: list[str]) -> DataFrame:
    """Pulled documents: callouts and fences canonical, profile applied, hashed."""
    called = canonical_callouts(docs, callouts)
    fenced = canonical_fences(called, aliases)
    text = T.canonical_markdown(T.filter_profile(F.col("text"), profile, known))
    return fenced.select("doc_id", text.alias("text")).select("doc_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("hash"))
