"""Column functions on Markdown text: canonical forms, keys, links, titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_ws(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def canonical_markdown(c: Column) -> Column:
    """LF line ends, no blanks at line ends, at most one empty line in a row, trimmed."""
    c = F.regexp_replace(c, r"\r\n", "\n")
    c = F.regexp_replace(c, r"[ \t]++(?=\n|\z)", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    # most texts need no trimming, and the pattern looks at every blank in a text to find that out
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), trim_ws(c)).otherwise(c)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def canonical_hash(c: Column) -> Column:
    return content_hash(canonical_markdown(c))


def normalize_ws(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, r"(?U)\s+", " "))


def heading_key(c: Column) -> Column:
    return F.lower(normalize_ws(c))


def canonical_line(line: Column) -> Column:
    """Outside code: ordered markers become ``1.``, table separators ``---`` with their alignment, NBSP a space."""
    body = F.regexp_replace(line, r"^(\s*)\d+[.)](\s+)", "$11.$2")
    trimmed = trim_ws(line)
    inner = F.regexp_replace(trimmed, r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"\|"), trim_ws)
    is_separator = F.contains(trimmed, F.lit("|")) & F.forall(cells, lambda x: x.rlike("^:?-+:?$"))
    kept = F.transform(cells, lambda x: F.concat(F.when(F.startswith(x, F.lit(":")), ":").otherwise(""), F.lit("---"), F.when(F.endswith(x, F.lit(":")), ":").otherwise("")))
    separator = F.concat(F.regexp_extract(line, r"^\s*", 0), F.lit("| "), F.array_join(kept, " | "), F.lit(" |"))
    return F.when(is_separator, separator).otherwise(F.replace(body, F.lit("\u00a0"), F.lit(" ")))


def collapse_includes(c: Column, primary: str, secondary: str) -> Column:
    """Include markup to the primary view: the primary's text stays, the secondary's goes, bare boundaries go.

    The text is cut at include spans, each is decided by its target, and lines that hold a boundary alone are emptied.
    """
    span = r"(?is)<include\b[^>]*>.*?</include>"
    spans, gaps = F.regexp_extract_all(c, F.lit(span), F.lit(0)), F.split(c, span)
    target = lambda s: F.lower(F.regexp_extract(F.regexp_extract(s, "^<[^>]*>", 0), r"(?i)\btarget\s*=\s*[\"']([^\"']*)[\"']", 1))
    inner = lambda s: F.regexp_extract(s, r"(?is)^<include\b[^>]*>(.*)</include>$", 1)
    view = lambda s: F.when(target(s) == primary.lower(), inner(s)).when(target(s) == secondary.lower(), "").otherwise(s)
    # blanks between a primary span and its secondary are part of the pair
    pair = lambda i: (target(F.get(spans, i - 1)) == primary.lower()) & (target(F.get(spans, i)) == secondary.lower())
    seen = F.transform(gaps, lambda g, i: F.concat(F.when((i > 0) & F.coalesce(pair(i), F.lit(False)) & (trim_ws(g) == ""), "").otherwise(g), F.coalesce(view(F.get(spans, i)), F.lit(""))))
    lines = F.transform(F.split(F.array_join(seen, ""), "\n"), lambda x: F.when(is_include_boundary(x), "").otherwise(x))
    return trim_ws(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def is_include_boundary(c: Column) -> Column:
    return trim_ws(c).rlike(r"(?i)^<include\b[^>]*>$|^</include>$")


def strip_heading_anchor(line: Column) -> Column:
    """A heading line without the ``{#anchor}`` at its end, escaped or not. Other lines stay."""
    return F.when(line.rlike(r"^ {0,3}#{1,6}\s"), F.regexp_replace(line, r"[ \t]*\\?\{#[\w-]+\}[ \t]*$", "")).otherwise(line)


def is_relative_doc(url: Column) -> Column:
    return ~url.rlike(r"(?i)^(?:#|/|[a-z][a-z0-9+.-]*:)")


def link_fragment(url: Column) -> Column:
    at = F.instr(url, "#")
    return F.when(at > 0, F.nullif(F.substring(url, at + 1, F.length(url)), F.lit("")))


def link_slug(url: Column, rule: str = "path") -> Column:
    """Document slug of a link. ``path``: last path part, a folder's name for its index, percent-decoded. ``file``: the file's name."""
    bare = F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    if rule == "file":
        parts = F.filter(F.split(F.regexp_replace(bare, r"^\./", ""), "/"), lambda p: p != "")
        return F.nullif(trim_ws(F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"(?i)\.(?:md|mdx)$", "")), F.lit(""))
    # a page is named by the last part of its path that isn't the index of a folder; '+' is no blank in a path
    names = F.filter(F.split(F.regexp_replace(bare, r"(?i)\.mdx?[/\\]*$", ""), r"[/\\]+"), lambda p: p != "")
    named = F.when(F.try_element_at(names, F.lit(-1)) == "index", F.slice(names, F.lit(1), F.size(names) - 1)).otherwise(names)
    return F.nullif(F.regexp_replace(trim_ws(F.try_url_decode(F.replace(F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit("")), F.lit("+"), F.lit("%2B")))), "^/+|/+$", ""), F.lit(""))


def normalize_slug(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(trim_ws(c), "^/+|/+$", ""), "^docs/", ""), F.lit(""))


def valid_doc_url(c: Column, hosts: list[str], paths: list[str]) -> Column:
    """An https URL on one of the hosts (or below them) and paths, without fragment; a Markdown link is unwrapped. Else null."""
    text = trim_ws(c)
    url = F.coalesce(F.nullif(F.regexp_extract(text, r"^\[[^\]]*\]\((https?://[^\s)]+)\)$", 1), F.lit("")), text)
    host = "|".join(h.replace(".", r"\.") for h in hosts)
    good = url.rlike(rf"(?i)^https://(?:[A-Za-z0-9.-]+\.)?(?:{host})/(?-i:{'|'.join(paths)})/[A-Za-z0-9_-]+/?(?:\?[^#\s]*)?(?:#.*)?$")
    return F.when(good, F.regexp_replace(F.split_part(url, F.lit("#"), F.lit(1)), "/$", ""))


def parse_target(c: Column, kinds: dict[str, str]) -> Column:
    """A bare id or a URL as (kind, token); ``kinds`` maps a URL path to a kind, the first one found wins. Null if neither."""
    text = trim_ws(c)
    out = F.lit(None).cast("struct<kind:string,token:string>")
    for path, kind in reversed(kinds.items()):
        token = F.regexp_extract(text, rf"^[a-z][a-z0-9+.-]*://[^/?#]+[^?#]*?/{path}/([A-Za-z0-9]+)", 1)
        out = F.when(token != "", F.struct(F.lit(kind).alias("kind"), token.alias("token"))).otherwise(out)
    first = next(iter(kinds.values()))
    return F.when(text.rlike("^[A-Za-z0-9]{16,}$"), F.struct(F.lit(first).alias("kind"), text.alias("token"))).otherwise(out)


def normalize_link(url: Column) -> Column:
    """Percent-decoded where only that makes the link an absolute http(s) URL."""
    decoded = F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))
    absolute = lambda u: u.rlike(r"(?i)^https?://[^/\s?#]+")
    return F.when(absolute(url), url).when(F.coalesce(absolute(decoded), F.lit(False)), decoded).otherwise(url)


def public_url(base: Column, slug: Column, fragment: Column) -> Column:
    tail = F.when(F.coalesce(fragment, F.lit("")) != "", F.concat(F.lit("#"), fragment)).otherwise("")
    return F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), F.regexp_replace(slug, "^/", ""), tail)


def resolve_title(text: Column, path: Column, explicit: Column) -> Column:
    """(title, source): the given title, else the first H1, else the file's base name."""
    given = F.nullif(trim_ws(explicit), F.lit(""))
    h1 = F.nullif(trim_ws(F.regexp_extract(text, r"(?md)^#\s+(\S[^\n]*?)[ \t\r]*$", 1)), F.lit(""))
    base = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", ""), F.lit("")), F.lit("Untitled"))
    source = F.when(given.isNotNull(), "option").when(h1.isNotNull(), "first H1").otherwise("file basename")
    return F.struct(F.coalesce(given, h1, base).alias("title"), source.alias("source"))


def split_frontmatter(text: Column) -> Column:
    """(frontmatter with its fences or null, body)."""
    t = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?U)^\s+", "")
    front = F.nullif(F.regexp_extract(t, r"(?s)^---\n.*?\n---(?:\n|$)", 0), F.lit(""))
    body = F.regexp_replace(F.substring(t, F.coalesce(F.length(front), F.lit(0)) + 1, F.length(t)), r"(?U)^\s+", "")
    return F.struct(F.regexp_replace(front, r"(?U)\s+$", "").alias("frontmatter"), body.alias("body"))


def frontmatter_scalars(front: Column) -> Column:
    """Map of the block's ``key: value`` lines; of a key that stands twice, the last."""
    lines = F.filter(F.split(front, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:[ \t]+\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("key"), trim_ws(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    later = lambda i: F.exists(F.slice(lines, i + 2, F.size(lines)), lambda x: F.split_part(x, F.lit(":"), F.lit(1)) == F.get(pairs, i)[F.lit("key")])
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~later(i)))


def frontmatter_nested(front: Column) -> Column:
    """Whether the block holds more than ``key: value`` lines: indented lines, lists, keys with nothing behind them."""
    return F.exists(F.split(front, "\n"), lambda x: x.rlike(r"^(?:[ \t]+\S|-[ \t]|[A-Za-z_][\w-]*:[ \t]*$)"))


def leading_h1(text: Column) -> Column:
    return F.nullif(trim_ws(F.regexp_extract(split_frontmatter(text)["body"], r"^#\s+([^\n]+?)(?:\n|$)", 1)), F.lit(""))


def strip_matching_title(local: Column, remote: Column, declared: Column) -> Column:
    """Local text without its leading H1 if the remote's H1 or the declared title is the same."""
    parts, mine = split_frontmatter(local), leading_h1(local)
    same = (mine == leading_h1(remote)) | (mine == trim_ws(declared))
    body = F.regexp_replace(F.regexp_replace(parts["body"], r"^#\s+[^\n]+?(?:\n{1,2}|$)", ""), r"(?U)^\s+", "")
    return F.when(F.coalesce(same, F.lit(False)), F.concat(F.coalesce(F.concat(parts["frontmatter"], F.lit("\n")), F.lit("")), body)).otherwise(local)


def visible_text(c: Column) -> Column:
    return normalize_ws(F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1"))


def text_equiv(a: Column, b: Column) -> Column:
    """Same visible text, or the same fenced code with languages that don't contradict."""
    fence = r"^```([^\n`]*)\n(?s:(.*?))\n```$"
    lang = lambda c: F.lower(F.trim(F.regexp_extract(c, fence, 1)))
    both = a.rlike(fence) & b.rlike(fence) & (F.regexp_extract(a, fence, 2) == F.regexp_extract(b, fence, 2))
    return (visible_text(a) == visible_text(b)) | (both & ((lang(a) == "") | (lang(b) == "") | (lang(a) == lang(b))))


def stable_json(columns: dict[str, Column]) -> Column:
    """JSON text whose keys stand in alphabetical order, whatever the order of ``columns``."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def locator_key(kind: Column, path: Column, ordinal: Column) -> Column:
    """One string for (kind, section path, ordinal); path parts are quoted, so no two paths look alike."""
    quoted = F.transform(path, lambda p: F.concat(F.lit('"'), F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(kind, F.lit(":["), F.array_join(quoted, ","), F.lit("]:"), ordinal.cast("string"))


def revision_reached(at: Column, wanted: Column) -> Column:
    """Numeric comparison where both are numbers, else equality."""
    number = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("decimal(38,0)"))
    return F.when(number(at).isNotNull() & number(wanted).isNotNull(), number(at) >= number(wanted)).otherwise(at == wanted)


def asset_key(path: Column) -> Column:
    """POSIX path without ``.``, ``x/..`` and doubled slashes."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != ".."), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(p))),
    )
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(folded, "/"))


def has_conflict_markers(c: Column) -> Column:
    return c.rlike(r"(?md)^<<<<<<< |^=======\s*$|^>>>>>>> ")


def callout_type(title: Column, icon: Column, titles: dict[str, str], icons: dict[str, str]) -> Column:
    """The type whose title or, failing that, whose icon it is."""
    key = heading_key(title)
    out = reduce(lambda other, kv: F.when(icon == kv[0], kv[1]).otherwise(other), reversed(icons.items()), F.lit(None).cast("string"))
    return reduce(lambda other, kv: F.when(key == kv[0], kv[1]).otherwise(other), reversed(titles.items()), out)


_PROFILE_SPAN = r"(?s)<(include|exclude)\b[^>]*>.*?</\1>"


def _targets(span: Column) -> Column:
    listed = F.regexp_extract(F.regexp_extract(span, r"^<[^>]*>", 0), r"\btarget\s*=\s*[\"']([^\"']+)[\"']", 1)
    return F.filter(F.split(listed, r"[,\s]+"), lambda t: t != "")


def profile_warnings(text: Column, known: list[str]) -> Column:
    """Why ``filter_profile`` leaves spans as they are, in order: ``include:no-target``, ``exclude:unknown:x,y``."""
    def warn(s: Column) -> Column:
        tag = F.regexp_extract(s, r"^<(\w+)", 1)
        unknown = F.filter(_targets(s), lambda t: ~t.isin(known))
        return F.when(F.size(_targets(s)) == 0, F.concat(tag, F.lit(":no-target"))).when(F.size(unknown) > 0, F.concat(tag, F.lit(":unknown:"), F.array_join(unknown, ",")))

    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(_PROFILE_SPAN), F.lit(0)), warn))


def filter_profile(text: Column, profile: str, known: list[str]) -> Column:
    """Include and exclude spans resolved for a profile. Spans without a target, or with an unknown one, stay.

    The text is cut at spans, each piece is decided by itself, and the pieces are put together again.
    """
    spans, gaps = F.regexp_extract_all(text, F.lit(_PROFILE_SPAN), F.lit(0)), F.split(text, _PROFILE_SPAN)

    def decide(s: Column) -> Column:
        targets = _targets(s)
        content = F.regexp_extract(s, r"(?s)^<(?:include|exclude)\b[^>]*>(.*)</(?:include|exclude)>$", 1)
        unknown = (F.size(targets) == 0) | F.exists(targets, lambda t: ~t.isin(known))
        keeps = F.array_contains(targets, profile) == F.startswith(s, F.lit("<include"))
        return F.when(unknown, s).when(keeps, content).otherwise("")

    kept = F.transform(spans, decide)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(kept, i), F.lit("")))), "")
