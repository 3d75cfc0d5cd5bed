"""Documents as typed blocks, their three container styles, and the way back from a text to its blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import bound_batches

# What splits a body, where a description may begin, and the words of a heading that name a type, in order.
SECTION = r"(?md)(^#{1,6}\s+.+$|```[\s\S]*?```|^\|.+\|\n\|[-:\s|]+\|\n(?:\|.+\|\n?)*)"
DESCRIPTION = r"(?md)^(?!#|>|```|-|\*|\d+\.)([A-Z0-9].{20,180}\.)"
BOLD = r"\*\*([A-\[Z][a-zA-Z0-9\s-]{2,30})\*\*"
TYPES = (
    ("summary", ("summary", "overview", "abstract")),
    ("concept", ("concept", "definition", "architecture", "theory")),
    ("procedure", ("step", "guide", "usage", "how to", "procedure", "installation")),
    ("note", ("note", "warning", "tip", "caution")),
    ("faq", ("faq", "question")),
    ("reference", ("reference", "link", "source")),
)
STYLES = ("container", "comment", "attribute")
_HEADER = r"(?s)^[^\S\n]*---[^\S\n]*\n((?:.*?\n)??)[^\S\n]*---[^\S\n]*(?:\n|$)"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _field(header: Column, keys: str) -> Column:
    """The value of the last line with one of the keys, without its quotes; empty if there is none."""
    line = F.get(F.reverse(F.regexp_extract_all(header, F.lit(rf"(?im)^[^\S\n]*(?:{keys})[^\S\n]*:(.*)$"), F.lit(1))), F.lit(0))
    return F.coalesce(F.regexp_replace(F.trim(line), "^['\"]|['\"]$", ""), F.lit(""))


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, title, description, tags, author, entities, body) of Markdown texts.

    What the header does not say comes from the body: its first heading, its first sentence that
    opens a line, its hash tags. A header that is never closed takes the whole text. A missing
    text is an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    opened = text.rlike(r"^[^\S\n]*---[^\S\n]*(?:\n|$)")
    closed = text.rlike(_HEADER)
    header = F.when(closed, F.regexp_extract(text, _HEADER, 1)).when(opened, F.regexp_replace(text, r"^[^\n]*\n?", "")).otherwise("")
    body = F.when(closed, F.regexp_replace(text, _HEADER, "")).when(opened, "").otherwise(text)
    read = docs.select(F.col(id_col).alias("doc_id"), header.alias("h"), body.alias("body"))
    title = F.coalesce(F.nullif(_field(F.col("h"), "title"), F.lit("")), F.nullif(_trimmed(F.regexp_extract("body", r"(?md)^#\s+(.+)$", 1)), F.lit("")), F.lit("Untitled Knowledge Document"))
    sentence = F.nullif(_trimmed(F.regexp_extract("body", DESCRIPTION, 1)), F.lit(""))
    description = F.coalesce(F.nullif(_field(F.col("h"), "description|summary"), F.lit("")), sentence, F.concat(F.lit("OKF Knowledge representation for "), title))
    named = F.filter(F.transform(F.split(F.regexp_replace(_field(F.col("h"), "tags"), r"^\[|\]$", ""), ","), lambda t: F.trim(t)), lambda t: t != "")
    tags = F.array_distinct(F.concat(named, F.regexp_extract_all("body", F.lit(r"(?:^|\s)#([a-zA-Z0-9_-]{3,20})"), F.lit(1))))
    usual = F.array(F.lit("knowledge"), F.lit("okf"), F.lit("markdown"))
    linked = F.regexp_extract_all("body", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    entities = F.slice(F.array_distinct(F.transform(F.concat(linked, F.regexp_extract_all("body", F.lit(BOLD), F.lit(1))), _trimmed)), 1, 15)
    author = F.coalesce(F.nullif(_field(F.col("h"), "author"), F.lit("")), F.lit("AI Studio OKF Engine"))
    return read.select("doc_id", title.alias("title"), description.alias("description"), F.when(F.size(tags) == 0, usual).otherwise(tags).alias("tags"), author.alias("author"), entities.alias("entities"), "body")


def blocks(meta: DataFrame, summary: bool = True) -> DataFrame:
    """(doc_id, ord, block_id, type, title, content, language) of the bodies that ``metadata`` gives.

    Headings give the pieces after them their title and, by its words, their type; fences and
    tables are blocks of their own. ``summary`` puts the description first.
    """
    gaps = F.split("body", SECTION, -1)
    marks = F.regexp_extract_all("body", F.lit(SECTION), F.lit(1))
    both = F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get(marks, i), F.lit("")))))
    pieces = meta.select("doc_id", F.posexplode(F.transform(both, _trimmed)).alias("at", "piece")).where("piece <> ''")
    is_heading = F.col("piece").rlike(r"^#{1,6}\s+")
    so_far = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.last(F.when(is_heading, _trimmed(F.regexp_replace("piece", r"^#{1,6}\s+", ""))), ignorenulls=True).over(so_far)
    under = pieces.withColumn("heading", heading).where(~is_heading)
    low, kind = F.lower("heading"), F.lit(None)
    for name, words in reversed(TYPES):
        kind = F.when(F.coalesce(low.rlike("|".join(words)), F.lit(False)), name).otherwise(kind)
    code, rows = F.col("piece").startswith("```"), F.col("piece").startswith("|")
    kind = F.when(code, "code").when(rows, "table").otherwise(F.coalesce(kind, F.lit("content")))
    titled = lambda label, plain: F.coalesce(F.concat(F.lit(label), F.nullif("heading", F.lit(""))), F.lit(plain))
    title = F.when(code, titled("Code: ", "Code Snippet")).when(rows, titled("Data: ", "Data Matrix")).otherwise(F.nullif("heading", F.lit("")))
    language = F.coalesce(F.nullif(_trimmed(F.regexp_extract("piece", r"^```([^\n]*)", 1)), F.lit("")), F.lit("text"))
    inner = F.regexp_extract("piece", r"(?s)^[^\n]*\n(.*)\n[^\n]*$", 1)
    body = under.select("doc_id", "at", kind.alias("type"), title.alias("title"), F.when(code, inner).otherwise(F.col("piece")).alias("content"), F.when(code, language).alias("language"))
    if summary:
        none = F.lit(None).cast("string")
        body = body.unionAll(meta.select("doc_id", F.lit(-1), F.lit("summary"), F.lit("Executive Summary"), F.col("description"), none))
    ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).cast("long")
    return body.withColumn("ord", ord_).select("doc_id", "ord", F.concat(F.lit("block-"), "ord").alias("block_id"), "type", "title", "content", "language")


def container_documents(meta: DataFrame, cut: DataFrame, date: str, style: str = "container", version: str = "1.0", kind: str = "knowledge-article") -> DataFrame:
    """(doc_id, text): header, title and blocks of every document in one of the three styles."""
    if style not in STYLES:
        raise ValueError(f"style is one of {', '.join(STYLES)}")
    quoted = F.coalesce(F.concat(F.lit(' "'), "title", F.lit('"')), F.lit(""))
    lang = F.coalesce(F.concat(F.lit(' lang="'), "language", F.lit('"')), F.lit(""))
    shown = F.when(F.col("type") == "code", F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), "content", F.lit("\n```"))).otherwise(F.col("content"))
    headed = F.coalesce(F.concat(F.lit("## "), "title", F.lit("\n\n")), F.lit(""))
    if style == "container":
        one = F.concat(F.lit(":::"), "type", quoted, F.lit(' {id="'), "block_id", F.lit('"'), lang, F.lit("}\n"), shown, F.lit("\n:::\n\n"))
    elif style == "comment":
        named = F.coalesce(F.concat(F.lit(' title="'), "title", F.lit('"')), F.lit(""))
        one = F.concat(F.lit('<!-- okf:block id="'), "block_id", F.lit('" type="'), "type", F.lit('"'), named, F.lit(" -->\n"), headed, shown, F.lit("\n\n"))
    else:
        mark = F.coalesce(F.concat(F.lit("## "), "title", F.lit(" {#"), "block_id", F.lit(" .okf-"), "type", F.lit("}\n\n")), F.concat(F.lit("<!-- okf:"), "type", F.lit(' id="'), "block_id", F.lit('" -->\n')))
        one = F.concat(mark, shown, F.lit("\n\n"))
    texts = cut.select("doc_id", "ord", one.alias("t")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), "").alias("blocks"))
    rows = (("okf", F.lit(version)), ("id", F.concat(F.lit("okf-"), "doc_id")), ("title", F.concat(F.lit('"'), "title", F.lit('"'))), ("description", F.concat(F.lit('"'), "description", F.lit('"'))), ("type", F.lit(kind)))
    top = F.concat(*(F.concat(F.lit(f"{k}: "), v, F.lit("\n")) for k, v in rows))
    tags = F.concat(F.lit("tags:\n"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("  - "), t, F.lit("\n"))), ""))
    end = F.concat(F.lit("author: "), "author", F.lit(f'\ncreated: {date}\nupdated: {date}\nproperties:\n  schema: "https://okf.md/spec/1.0"\n  source: "AI Studio Converter"\n  entityCount: "'), F.size("entities").cast("string"), F.lit('"\n---\n\n# '), "title", F.lit("\n\n"))
    return meta.join(texts, "doc_id", "left").select("doc_id", _trimmed(F.concat(F.lit("---\n"), top, tags, end, F.coalesce("blocks", F.lit("")))).alias("text"))


_OPEN = re.compile(r':::([a-z][\w-]*)(?: "(.*)")?(?: \{(?:id="([^"]*)")?(?: ?lang="([^"]*)")?\})?[ \t]*$')
_COMMENT = re.compile(r'<!-- okf:block id="([^"]*)" type="([^"]*)"(?: title="(.*)")? -->[ \t]*$')
_HEADED = re.compile(r"#{1,6} (.*) \{#([^ }]+) \.okf-([\w-]+)\}[ \t]*$")
_BARE = re.compile(r'<!-- okf:([\w-]+) id="([^"]*)" -->[ \t]*$')


def _mark(line: str) -> tuple[str, str, str | None, str, str | None] | None:
    """(style, type, title, id, language) of a line that opens a block."""
    if line.startswith(":::"):
        m = _OPEN.match(line)
        return m and ("container", m[1], m[2], m[3] or "", m[4])
    if line.startswith("<!-- okf:"):
        m = _COMMENT.match(line)
        if m:
            return ("comment", m[2], m[3], m[1], None)
        m = _BARE.match(line)
        return m and ("attribute", m[1], None, m[2], None)
    m = _HEADED.match(line) if line.startswith("#") else None
    return m and ("attribute", m[3], m[1], m[2], None)


def read_blocks(text: str) -> list[tuple]:
    """(parent, style, id, type, title, content, language) of a text's blocks in the order of their marks.

    Containers nest: their open marks lie on a stack until a closing line, or the end. A block of
    the other styles ends where the next one begins. Lines inside a fence open and close nothing;
    a fence counts if it closes before the next line that would open a block with an id.
    """
    lines = text.split("\n")
    n = len(lines)
    marks = [_mark(s) for s in lines]
    # From the end: the next fence line and the next mark with an id.
    fence_at, mark_at = [n] * (n + 1), [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        fence_at[i] = i if lines[i].startswith("```") else fence_at[i + 1]
        mark_at[i] = i if marks[i] and marks[i][3] else mark_at[i + 1]
    out: list[list] = []
    stack: list[int] = []

    def close() -> None:
        block = out[stack.pop()]
        body = block[5]
        if block[1] == "comment" and block[4] is not None and body[:1] == [f"## {block[4]}"]:
            body = body[1:]
        held = "\n".join(body).strip("\n") if block[3] != "code" else "\n".join(body).strip()
        if block[3] == "code":
            m = re.match(r"```([^\n]*)\n(.*)\n```$", held, re.S) or re.match(r"```([^\n]*)\n()```$", held)
            if m:
                held, block[6] = m[2], block[6] or m[1] or None
        block[5] = held

    i = 0
    while i < n:
        line, mark = lines[i], marks[i]
        if line.startswith("```") and (end := fence_at[i + 1]) < n and end < mark_at[i + 1]:
            if stack:
                out[stack[-1]][5] += lines[i : end + 1]
            i = end + 1
            continue
        if mark:
            style, kind, title, name, language = mark
            while stack and (style != "container" or out[stack[-1]][1] != "container"):
                close()
            out.append([stack[-1] if stack else None, style, name, kind, title, [], language])
            stack.append(len(out) - 1)
        elif stack and out[stack[-1]][1] == "container" and line.rstrip() == ":::":
            close()
        elif stack:
            out[stack[-1]][5].append(line)
        i += 1
    while stack:
        close()
    return [tuple(b) for b in out]


def container_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ord, parent, style, block_id, type, title, content, language): the blocks that container texts hold.

    ``ord`` counts from 1, ``parent`` is the ord of the block around a nested one. A missing text
    has no blocks. What ``container_documents`` writes comes back as it was, unless a line of its
    content is itself a mark outside a fence, or a container's content has a line of three colons.
    """
    fields = "doc_id long, ord long, parent long, style string, block_id string, type string, title string, content string, language string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, doc in enumerate(b.column(0).to_pylist()):
                found = read_blocks(b.column(1)[at].as_py() or "")
                if found:
                    parent, *rest = (list(c) for c in zip(*found, strict=True))
                    up = [None if p is None else p + 1 for p in parent]
                    longs = [pa.array(x, pa.int64()) for x in ([doc] * len(found), range(1, len(found) + 1), up)]
                    yield pa.RecordBatch.from_arrays(longs + [pa.array(c, pa.string()) for c in rest], [f.split()[0] for f in fields.split(", ")])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, fields)
