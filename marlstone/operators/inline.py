"""Inline grammar of Markdown: a nested tree, flattened to rows, and rendered as text, HTML or XML.

Trees recurse, which no schema can, so nodes become rows that name their parents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.markdown import Lexer
from marlstone.session import bound_batches


@dataclass
class Node:
    kind: str
    text: str = ""
    url: str = ""
    children: list[Node] = field(default_factory=list)


#: Inline forms in order of precedence: kind, pattern, group of the inner text, group of the address.
_FORMS = [
    ("code", re.compile(r"`([^`\n]+)`"), 1, None),
    ("math", re.compile(r"\$([^$\n]+)\$"), 1, None),
    ("image", re.compile(r"!\[([^\]]*)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"), 1, 2),
    ("wikilink", re.compile(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"), 1, 2),
    ("link", re.compile(r"\[([^\]]+)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"), 1, 2),
    ("autolink", re.compile(r"<(https?://[^>\s]+)>"), 1, 1),
    ("strong", re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), 2, None),
    ("strikethrough", re.compile(r"~~(.+?)~~"), 1, None),
    ("emphasis", re.compile(r"(\*|_)(?=\S)(.+?)(?<=\S)\1"), 2, None),
]
_LEAVES = {"code", "math", "image", "wikilink", "autolink"}
_MOST_DEPTH = 12


def parse_inline(text: str, depth: int = 0) -> list[Node]:
    """The inline nodes of a text: the earliest form wins, of equals the first in precedence."""
    out: list[Node] = []
    at = 0
    while at < len(text):
        best = None
        if depth < _MOST_DEPTH:
            for rank, (kind, pattern, inner, url) in enumerate(_FORMS):
                m = pattern.search(text, at)
                if m and (best is None or (m.start(), rank) < best[:2]):
                    best = (m.start(), rank, kind, m, inner, url)
        if best is None:
            out.append(Node("text", text[at:]))
            break
        start, _, kind, m, inner, url = best
        if start > at:
            out.append(Node("text", text[at:start]))
        node = Node(kind, m[inner], (m[url] or "") if url else "")
        if kind not in _LEAVES:
            node.children = parse_inline(m[inner], depth + 1)
        out.append(node)
        at = m.end()
    return out


def plain_text(nodes: list[Node]) -> str:
    return "".join((n.url or n.text) if n.kind == "wikilink" else plain_text(n.children) if n.children else n.text for n in nodes)


def safe_url(url: str) -> str:
    """The address, or # where its scheme is none of http, https, mailto or relative."""
    scheme = re.match(r"\s*([A-Za-z][A-Za-z0-9+.-]*):", re.sub(r"[\x00-\x20]", "", url))
    return "#" if scheme and scheme[1].lower() not in ("http", "https", "mailto") else url


def safe_url_column(url: Column) -> Column:
    clean = F.regexp_replace(url, r"[\x00-\x20]", "")
    scheme = F.lower(F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when((scheme != "") & ~scheme.isin("http", "https", "mailto"), "#").otherwise(url)


_TAGS = {"strong": "strong", "emphasis": "em", "strikethrough": "del", "code": "code"}


def inline_html(nodes: list[Node]) -> str:
    out = []
    for n in nodes:
        inner = inline_html(n.children) if n.children else escape(n.text)
        if n.kind in _TAGS:
            out.append(f"<{_TAGS[n.kind]}>{inner}</{_TAGS[n.kind]}>")
        elif n.kind in ("link", "autolink"):
            out.append(f'<a href="{escape(safe_url(n.url))}">{inner}</a>')
        elif n.kind == "image":
            out.append(f'<img src="{escape(safe_url(n.url))}" alt="{escape(n.text)}">')
        elif n.kind == "wikilink":
            out.append(f'<a class="wikilink" href="#{escape(n.text)}">{escape(n.url or n.text)}</a>')
        elif n.kind == "math":
            out.append(f'<span class="math">{inner}</span>')
        else:
            out.append(inner)
    return "".join(out)


def tree(text: str) -> Node:
    """The document's blocks with their inline nodes."""
    root = Node("document")
    for b in Lexer(text or "").blocks():
        node = Node(b["kind"], b["content"] if b["content"] is not None else b["raw"], str(b["depth"] or b["language"] or ""))
        if b["kind"] == "heading":
            node.children = parse_inline(b["content"])
        elif b["kind"] == "paragraph":
            node.children = parse_inline(b["raw"])
        elif b["kind"] == "blockquote":
            node.children = tree(re.sub(r"(?m)^\s*>\s?", "", b["raw"])).children
        elif b["kind"] == "list":
            items = re.split(r"(?m)^\s*(?:[-*+]|\d+\.)\s+", b["raw"])[1:]
            node.children = [Node("list_item", i.strip(), "x" if re.match(r"\[[xX]\]", i) else "", parse_inline(re.sub(r"^\[[ xX]\]\s*", "", i.strip()))) for i in items]
        elif b["kind"] == "table":
            rows = [r for r in b["raw"].split("\n") if r.strip()]
            cut = [[c.strip() for c in r.strip().strip("|").split("|")] for r in rows[:1] + rows[2:]]
            node.children = [Node("table_row", "", "header" if i == 0 else "", [Node("table_cell", c, "", parse_inline(c)) for c in r]) for i, r in enumerate(cut)]
        root.children.append(node)
    return root


def to_html(node: Node) -> str:
    inner = "\n".join(to_html(c) for c in node.children) if node.kind in ("document", "blockquote", "list", "table", "table_row") else inline_html(node.children)
    if node.kind == "document":
        return inner
    if node.kind == "heading":
        return f"<h{node.url}>{inner}</h{node.url}>"
    if node.kind in ("code_block", "mermaid_diagram"):
        return f'<pre><code class="language-{escape(node.url)}">{escape(node.text)}</code></pre>'
    if node.kind == "math_block":
        return f'<div class="math">{escape(node.text)}</div>'
    if node.kind == "thematic_break":
        return "<hr>"
    if node.kind == "table_cell":
        return f"<td>{inner}</td>"
    name = {"paragraph": "p", "blockquote": "blockquote", "list": "ol" if re.match(r"\s*\d", node.text) else "ul", "list_item": "li", "table": "table", "table_row": "tr"}.get(node.kind)
    return f"<{name}>{inner}</{name}>" if name else ""


def to_xml(node: Node, depth: int = 0) -> str:
    pad = "  " * depth
    detail = f' detail="{escape(node.url)}"' if node.url else ""
    if not node.children:
        return f"{pad}<{node.kind}{detail}>{escape(node.text)}</{node.kind}>"
    return f"{pad}<{node.kind}{detail}>\n" + "\n".join(to_xml(c, depth + 1) for c in node.children) + f"\n{pad}</{node.kind}>"


def _flat(node: Node, parent: int, out: list[tuple]) -> None:
    me = len(out)
    out.append((me, parent, node.kind, node.text, node.url))
    for c in node.children:
        _flat(c, me, out)


def ast_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node_id, parent_id, kind, text, detail) of every node, the document's own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["doc_id", "node_id", "parent_id", "kind", "text", "detail"], [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            rows: list[tuple] = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own: list[tuple] = []
                _flat(tree(t), -1, own)
                rows += [(d, *r) for r in own]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, node_id int, parent_id int, kind string, text string, detail string")


def node_counts(nodes: DataFrame) -> DataFrame:
    """(doc_id, nodes, headings, links, images, tables, formulas) of each document."""
    n = lambda *k: F.count_if(F.col("kind").isin(*k))
    return nodes.groupBy("doc_id").agg((F.count("*") - 1).alias("nodes"), n("heading").alias("headings"), n("link", "wikilink", "autolink").alias("links"), n("image").alias("images"), n("table").alias("tables"), n("math", "math_block").alias("formulas"))


def matching_nodes(nodes: DataFrame, kind: str = "", word: str = "") -> DataFrame:
    """Nodes whose kind holds one text and whose row, as JSON, holds the other."""
    row = F.to_json(F.struct("kind", "text", "detail"))
    return nodes.where(F.lower("kind").contains(kind.lower()) & F.lower(row).contains(word.lower()))


def rendered(docs: DataFrame, form: str = "html", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rendered): each document as HTML or XML."""
    write = to_xml if form == "xml" else to_html

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([write(tree(t.as_py())) for t in b.column(1)], pa.string())], ["doc_id", "rendered"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, rendered string")
