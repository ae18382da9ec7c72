"""Segments of mixed documents: nested tables and containers, callouts, nodes of all kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import segments as G
from textloom.queries import query
from textloom.runtime import table

#: Tables by variant: what is written, and what must be read.
_ROW = "<tr><td>{a}</td><td>{b}</td></tr>"
_TABLE = "<table><tr><th>Key</th><th>Of &amp; to</th></tr>{rows}</table>"
TABLES = {
    0: (_TABLE.format(rows=_ROW.format(a="a", b="<table><tr><td>in</td></tr></table> out") + _ROW.format(a="b", b="x")), ["Key|Of & to", "a|in out", "b|x"], "nested-table"),
    1: (_TABLE.format(rows='<tr><td colspan="2">a</td></tr>'), ["Key|Of & to", "a"], "merged-cells,ragged"),
    2: (_TABLE.format(rows=_ROW.format(a="a", b='<a href="./x">x</a> <a href="https://e.com">y</a>')), ["Key|Of & to", "a|x y"], "relative-link"),
    3: (_TABLE.format(rows=_ROW.format(a="a", b="1") + _ROW.format(a=" a ", b="2") + _ROW.format(a="", b="3")), ["Key|Of & to", "a|1", "a|2", "|3"], "duplicate-key:a,empty-key"),
    4: ("```html\n" + _TABLE.format(rows=_ROW.format(a="a", b="1")) + "\n```", None, None),
    5: ("<table></table>", [], "no-rows"),
    6: ("<div><table><tr><td>a</td></tr></table></div>", None, None),
    7: ("<TABLE class='t'><thead><tr><th>K<th>V</tr></thead><tbody><tr><td colspan='1'>a<td>1</tr></tbody></TABLE>", ["K|V", "a|1"], ""),
}


def _text(variants: dict, key: str):
    """Each order's text by its key's variant; ``§`` is the order's key."""
    whens = None
    for v, (text, *_) in variants.items():
        whens = (F.when if whens is None else whens.when)(F.col(key) % len(variants) == v, F.replace(F.lit(text), F.lit("§"), F.col(key).cast("string")))
    return whens


def _orders(spark, sf, variants):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), _text(variants, "o_orderkey").alias("text"))


def _sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_TABLE_VALUES = ", ".join(f"({v}, {_sql_text(chr(10).join(rows))}, {max(0, len(rows) - 1)}, {_sql_text(issues)})" for v, (_, rows, issues) in TABLES.items() if rows is not None)


@query(f"SELECT o_orderkey AS doc_id, 0 AS seg, shown, n_rows, issues FROM orders JOIN (VALUES {_TABLE_VALUES}) v(variant, shown, n_rows, issues) ON variant = o_orderkey % {len(TABLES)}")
def html_table_nodes(spark, sf):
    found = G.html_table_nodes(_orders(spark, sf, TABLES))
    lines = F.when(F.size("headers") + F.size("rows") > 0, F.array_join(F.concat(F.array(F.array_join("headers", "|")), F.transform("rows", lambda r: F.array_join(r["cells"], "|"))), "\n")).otherwise("")
    return found.select("doc_id", "seg", lines.alias("shown"), F.size("rows").alias("n_rows"), F.array_join("issues", ",").alias("issues"))


CALLOUTS = {
    0: ("Before\n<div class=\"alert note\" data-title=\"A &quot;b&quot;\">\nSee <div>inner</div> there.\n\n- one §\n</div>\nAfter", "note", 'A "b"', "nested", ["paragraph:See <div>inner</div> there.", "bullet:one §"]),
    1: ("<div class='x alert warning'># T\n\ntext [l](./m) and ![i](p)</div>", "warning", None, "image,relative-link", ["heading:T", "paragraph:text [l](./m) and ![i](p)"]),
    2: ('<div class="alert warning"></div>', "warning", None, "", []),
    3: ('<div class="alerts note">plain §</div>', None, None, None, None),
    4: ('<div class="alert note">\n```\n</div>\n```\n</div>\n> q', "note", None, "fenced-code", ["code:```"]),
}
_CALLOUT_VALUES = ", ".join(f"({v}, {1 if v == 0 else 0}, {_sql_text(kind)}, {_sql_text(title)}, {_sql_text(issues)}, {_sql_text('|'.join(children))})" for v, (_, kind, title, issues, children) in CALLOUTS.items() if kind)


@query(f"SELECT o_orderkey AS doc_id, seg, type, title, issues, replace(children, '§', CAST(o_orderkey AS VARCHAR)) AS children FROM orders JOIN (VALUES {_CALLOUT_VALUES}) v(variant, seg, type, title, issues, children) ON variant = o_orderkey % {len(CALLOUTS)}")
def callout_nodes(spark, sf):
    docs = _orders(spark, sf, CALLOUTS)
    children = G.callout_child_nodes(docs).groupBy("doc_id", "seg").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.concat_ws(":", "kind", "text").alias("t")))).alias("c"))
    j = G.callout_nodes(docs).join(children, ["doc_id", "seg"], "left")
    return j.select("doc_id", "seg", "type", "title", F.array_join("issues", ",").alias("issues"), F.coalesce(F.array_join(F.transform("c", lambda x: x["t"]), "|"), F.lit("")).alias("children"))


#: Mixed documents and their nodes (kind, block type, section, ordinal, content).
NODES = {
    0: ("---\ntitle: §\n---\n# One\ntext §\n```py\n<table>\n```\n## Two\n<table><tr><td><table></table></td></tr></table>tail\n", [
        ("opaque", "frontmatter", "", 0, "---\ntitle: §\n---\n"), ("text", "heading", "one", 0, "One"), ("text", "paragraph", "one", 1, "text §"), ("code", "code", "one", 0, "```py\n<table>\n```\n"),
        ("text", "heading", "one/two", 0, "Two"), ("table", "table", "one/two", 0, "<table><tr><td><table></table></td></tr></table>"), ("text", "paragraph", "one/two", 1, "tail"),
    ]),
    1: ("<Procedures>\n\n1. step\n\n</Procedures>\n\n![a](b.png)\n\n    ```\n    deep\n    ```\n<div class=\"alert note\">x<div>y</div></div>\n<div>z", [
        ("authoring-token", "paragraph", "", 0, "<Procedures>"), ("text", "ordered", "", 0, "step"), ("authoring-token", "paragraph", "", 1, "</Procedures>"), ("asset", "paragraph", "", 0, "![a](b.png)"),
        ("opaque", "indented", "", 0, "    ```\n    deep\n    ```\n"), ("callout", "callout", "", 0, '<div class="alert note">x<div>y</div></div>'), ("opaque", "open-div", "", 1, "<div>z"),
    ]),
    2: ("### Deep §\n| a |\n| - |\n</table>\n<readonly-block type=\"isv\"></readonly-block>\n# Up\n~~~\nopen", [
        ("text", "heading", "deep §", 0, "Deep §"), ("table", "table", "deep §", 0, "| a |\n| - |"), ("text", "paragraph", "deep §", 1, '</table> <readonly-block type="isv"></readonly-block>'),
        ("text", "heading", "up", 0, "Up"), ("code", "code", "up", 0, "~~~\nopen"),
    ]),
}
_NODE_VALUES = ", ".join(f"({v}, {i}, '{kind}', '{block}', {_sql_text(section)}, {n}, {_sql_text(content)})" for v, (_, nodes) in NODES.items() for i, (kind, block, section, n, content) in enumerate(nodes))


@query(f"SELECT o_orderkey AS doc_id, node_no, kind, block_type, replace(section, '§', CAST(o_orderkey AS VARCHAR)) AS section, ordinal, sha256(replace(content, '§', CAST(o_orderkey AS VARCHAR))) AS content_hash FROM orders JOIN (VALUES {_NODE_VALUES}) v(variant, node_no, kind, block_type, section, ordinal, content) ON variant = o_orderkey % {len(NODES)}")
def document_nodes(spark, sf):
    from pyspark.sql import Window

    nodes = G.local_nodes(_orders(spark, sf, NODES))
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("seg", "block_no")) - 1
    return nodes.select("doc_id", no.alias("node_no"), "kind", "block_type", F.array_join("section", "/").alias("section"), "ordinal", F.sha2("content", 256).alias("content_hash"))


SELECTORS = {
    0: ('a\n<div class="lang filter">\n<div>x</div>\n</div>\nb §', "a\nb §"),
    1: ("- item\n    ```sh\n    run §\n      deep\n    ```\nend", "- item\n```sh\nrun §\n  deep\n```\nend"),
    2: ('```\n<div class="filter"></div>\n```\n<div class="filters">§</div>', '```\n<div class="filter"></div>\n```\n<div class="filters">§</div>'),
}
_SELECTOR_VALUES = ", ".join(f"({v}, {_sql_text(want)})" for v, (_, want) in SELECTORS.items())


@query(f"SELECT o_orderkey AS doc_id, replace(want, '§', CAST(o_orderkey AS VARCHAR)) AS text FROM orders JOIN (VALUES {_SELECTOR_VALUES}) v(variant, want) ON variant = o_orderkey % {len(SELECTORS)}")
def drop_containers(spark, sf):
    return G.drop_containers(_orders(spark, sf, SELECTORS), "filter")


ADMONITIONS = {
    0: ('<Admonition type="Warning">\nText §\n</Admonition>', "warning", None, "Text §", None),
    1: ('a <Admonition title="T &amp; u">x</Admonition>', "note", "T & u", "x", "titled"),
    2: ('<Admonition type="note"><Admonition type="tip">in</Admonition> out</Admonition>', "note", None, '<Admonition type="tip">in</Admonition> out', "nested"),
    3: ('<Admonition type="note">\nopen <Admonition/> §', "note", None, "open <Admonition/> §", "unclosed"),
    4: ('```\n<Admonition type="note">\n```\n<Admonition/> plain', None, None, None, None),
}
_ADMONITION_VALUES = ", ".join(f"({v}, {1 if v == 1 else 0}, '{kind}', {_sql_text(title)}, {_sql_text(body)}, {_sql_text(blocker)})" for v, (_, kind, title, body, blocker) in ADMONITIONS.items() if kind)


@query(f"SELECT o_orderkey AS doc_id, seg, type, title, replace(body, '§', CAST(o_orderkey AS VARCHAR)) AS body, blocker FROM orders JOIN (VALUES {_ADMONITION_VALUES}) v(variant, seg, type, title, body, blocker) ON variant = o_orderkey % {len(ADMONITIONS)}")
def component_admonitions(spark, sf):
    return G.component_admonitions(_orders(spark, sf, ADMONITIONS))


def _said(kind: str, block: str, content: str) -> str:
    """What a node of the fixture is hashed by, told by hand for code and callouts."""
    given = {"```py\n<table>\n```\n": "code|py|<table>", "~~~\nopen": "code||open", '<div class="alert note">x<div>y</div></div>': "callout|note||x<div>y</div>"}
    return given.get(content, f"text|{block}|{content}" if kind == "text" else f"{kind}|{content}")


_SAID_VALUES = ", ".join(f"({v}, {i}, {_sql_text(_said(kind, block, content))})" for v, (_, nodes) in NODES.items() for i, (kind, block, _, _, content) in enumerate(nodes))


@query(f"SELECT o_orderkey AS doc_id, node_no, sha256(replace(said, '§', CAST(o_orderkey AS VARCHAR))) AS hash FROM orders JOIN (VALUES {_SAID_VALUES}) v(variant, node_no, said) ON variant = o_orderkey % {len(NODES)}")
def semantic_hashes(spark, sf):
    from pyspark.sql import Window

    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("seg", "block_no")) - 1
    return G.semantic_hashes(G.local_nodes(_orders(spark, sf, NODES)), "alpha", "beta").select("doc_id", no.alias("node_no"), "hash")
