"""Markdown documents: blocks, breadcrumbs, chunks, sections, links, fences, directives, windows.

The block grammar is sequential within a document, so it runs over Arrow batches of documents, in
one narrow pass. What is line- or window-shaped is native.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.session import bound_batches

_HEADING = re.compile(r"(#{1,6})\s+(.*?)(?:\s+#+)?$")
_DELIMITER = re.compile(r"\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)+\|?")
_RULE = re.compile(r"(\*\s*){3,}|(-\s*){3,}|(_\s*){3,}")
_ITEM = re.compile(r"([-*+]|\d+\.)\s+")
_IMAGE = re.compile(r'!\[([^\]]*)\]\((https?://[^\s)]+|[^)\s]+)(?:\s+"([^"]*)")?\)')
_LINK = re.compile(r'(?<!!)\[([^\]]+)\]\((https?://[^\s)]+|[^)\s]+)(?:\s+"([^"]*)")?\)')


def flat_yaml(text: str) -> dict[str, str]:
    """Top-level ``key: value`` pairs, inline and dashed lists joined by commas."""
    out: dict[str, str] = {}
    key = ""
    for line in text.split("\n"):
        m = re.match(r"([A-Za-z_][\w-]*)\s*:\s*(.*)$", line)
        if m:
            key, value = m[1], m[2].strip()
            if value.startswith("[") and value.endswith("]"):
                value = ", ".join(v.strip().strip("\"'") for v in value[1:-1].split(",") if v.strip())
            out[key] = value.strip("\"'")
        elif key and (m := re.match(r"\s*-\s+(.*)$", line)):
            item = m[1].strip().strip("\"'")
            out[key] = f"{out[key]}, {item}" if out[key] else item
    return out


def _cells(row: str) -> list[str]:
    return [c.strip() for c in row.strip().removeprefix("|").removesuffix("|").split("|")]


class Lexer:
    """Cuts one document into blocks. Each rule says whether a line starts its kind and what it takes."""

    def __init__(self, text: str) -> None:
        self.lines = re.split(r"\r?\n", text)
        self.bare = [x.strip() for x in self.lines]

    def is_table(self, i: int) -> bool:
        return i + 1 < len(self.lines) and "|" in self.bare[i] and bool(_DELIMITER.fullmatch(self.bare[i + 1]))

    def is_fence(self, i: int) -> bool:
        return self.bare[i].startswith(("```", "~~~"))

    def is_heading(self, i: int) -> bool:
        return bool(re.match(r"#{1,6}\s", self.bare[i]))

    def is_item(self, i: int) -> bool:
        return bool(_ITEM.match(self.bare[i]))

    def starts(self, i: int) -> str:
        """The kind of block that starts at a line."""
        b = self.bare[i]
        rules: tuple[tuple[str, bool | Callable[[], bool]], ...] = (
            ("blank", not b), ("math_block", b.startswith("$$")), ("code_block", self.is_fence(i)), ("heading", self.is_heading(i)), ("table", self.is_table(i)),
            ("thematic_break", bool(_RULE.fullmatch(b))), ("blockquote", b.startswith(">")), ("list", self.is_item(i)),
        )
        return next((kind for kind, holds in rules if holds), "paragraph")

    def end_of(self, kind: str, i: int) -> int:
        """The line after the block of a kind that starts at line i."""
        n, b = len(self.lines), self.bare
        j = i + 1
        if kind in ("heading", "thematic_break", "blank"):
            return j
        if kind == "math_block":
            if len(b[i]) > 4 and b[i].endswith("$$"):
                return j
            while j < n and not b[j].endswith("$$"):
                j += 1
            return min(n, j + 1)
        if kind == "code_block":
            mark = re.match(r"[`~]+", b[i])[0]
            mark = mark[0] * len(mark)
            while j < n and not b[j].startswith(mark):
                j += 1
            return min(n, j + 1)
        if kind == "table":
            while j < n and "|" in b[j]:
                j += 1
            return j
        if kind == "blockquote":
            while j < n and b[j] and (b[j].startswith(">") or self.lines[j].startswith(" ")):
                j += 1
            return j
        if kind == "list":
            while j < n:
                if not b[j]:
                    if j + 1 < n and (self.lines[j + 1].startswith("  ") or self.is_item(j + 1)):
                        j += 1
                        continue
                    break
                if self.is_heading(j) or self.is_fence(j) or self.is_table(j):
                    break
                j += 1
            return j
        while j < n and self.starts(j) == "paragraph":
            j += 1
        return j

    def blocks(self) -> Iterator[dict]:
        i, n = 0, len(self.lines)
        if n and self.bare[0] == "---":
            close = next((j for j in range(1, n) if self.bare[j] == "---"), None)
            if close is None:  # an open header takes the whole text
                return
            yield self.block("yaml_frontmatter", 0, close + 1, content="\n".join(self.lines[1:close]))
            i = close + 1
        while i < n:
            kind = self.starts(i)
            end = self.end_of(kind, i)
            if kind != "blank":
                yield self.block(kind, i, end)
            i = end

    def block(self, kind: str, i: int, end: int, content: str | None = None) -> dict:
        raw = "\n".join(self.lines[i:end])
        out = {"kind": kind, "raw": raw, "start_line": i + 1, "end_line": end, "depth": None, "content": content, "language": None, "is_ordered": None, "headers": None, "n_rows": None}
        first = self.bare[i]
        if kind == "heading":
            m = _HEADING.match(first)
            out["depth"], out["content"] = len(m[1]), m[2].strip()
        elif kind == "code_block":
            mark = re.match(r"[`~]+", first)[0]
            words = first[len(mark) :].split()
            language = words[0].lower() if words else ""
            closed = end - i > 1 and self.bare[end - 1].startswith(mark)
            out["content"], out["language"] = "\n".join(self.lines[i + 1 : end - closed]), language
            out["kind"] = {"mermaid": "mermaid_diagram", "math": "math_block", "latex": "math_block"}.get(language, kind)
        elif kind == "math_block":
            body = first[2:-2].strip() if end == i + 1 and len(first) > 4 else "\n".join(self.lines[i + 1 : end]).rstrip()
            out["content"] = body.removesuffix("$$") if end > i + 1 else body
        elif kind == "list":
            out["is_ordered"] = first[0].isdigit()
        elif kind == "table":
            out["headers"], out["n_rows"] = _cells(self.lines[i]), end - i - 2
        out["links"] = [m[2] for m in _LINK.finditer(raw)]
        out["images"] = [m[2] for m in _IMAGE.finditer(raw)]
        return out


_BLOCK_FIELDS = [
    ("doc_id", pa.int64()), ("ord", pa.int32()), ("kind", pa.string()), ("raw", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("depth", pa.int32()), ("content", pa.string()),
    ("language", pa.string()), ("is_ordered", pa.bool_()), ("headers", pa.list_(pa.string())), ("n_rows", pa.int32()), ("links", pa.list_(pa.string())), ("images", pa.list_(pa.string())),
]
BLOCKS = "doc_id long, ord int, kind string, raw string, start_line int, end_line int, depth int, content string, language string, is_ordered boolean, headers array<string>, n_rows int, links array<string>, images array<string>"


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each block, in document order, with its characters and estimated tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_BLOCK_FIELDS)
        for b in batches:
            rows = [{"doc_id": d.as_py(), "ord": i, **x} for d, t in zip(b.column(0), b.column(1), strict=True) for i, x in enumerate(Lexer(t.as_py() or "").blocks())]
            yield pa.RecordBatch.from_pylist(rows, schema)

    bound_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, BLOCKS)
    return found.withColumns({"chars": F.length("raw").cast("long"), "tokens": F.ceil(F.length("raw") / 4).cast("long")})


def with_breadcrumbs(found: DataFrame, default_title: str = "Untitled Document", delimiter: str = " > ") -> DataFrame:
    """Blocks with title, breadcrumb, heading and heading level.

    A heading of a level holds until one of its level or above comes; by windows over a document.
    """
    past = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("doc_id")
    is_level = lambda k: (F.col("kind") == "heading") & (F.col("depth") == k)
    df = found.withColumns({f"at{k}": F.max(F.when(is_level(k), F.struct("ord", "content"))).over(past) for k in range(1, 7)})
    levels = []
    for k in range(1, 7):
        above = [F.coalesce(F.col(f"at{j}.ord"), F.lit(-1)) for j in range(1, k)]
        holds = F.col(f"at{k}").isNotNull() & (F.col(f"at{k}.ord") > (F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(-1)))
        levels.append(F.when(holds, F.struct(F.lit(k).alias("level"), F.col(f"at{k}.content").alias("heading"))))
    front = F.max(F.when(F.col("kind") == "yaml_frontmatter", F.regexp_extract("content", r'(?m)^title\s*:\s*["\']?(.*?)["\']?\s*$', 1))).over(whole)
    h1 = F.min(F.when(is_level(1), F.struct("ord", "content"))).over(whole)["content"]
    df = df.withColumn("open", F.filter(F.array(*levels), lambda x: x.isNotNull())).withColumn("title", F.coalesce(F.nullif(front, F.lit("")), F.nullif(h1, F.lit("")), F.lit(default_title)))
    none = F.size("open") == 0
    last = F.try_element_at("open", F.lit(-1))
    return df.withColumns({
        "breadcrumb": F.when(none, F.col("title")).otherwise(F.array_join(F.transform("open", lambda x: x["heading"]), delimiter)),
        "heading": F.when(none, F.col("title")).otherwise(last["heading"]),
        "heading_level": F.when(none, 0).otherwise(last["level"]),
    }).drop("open", *(f"at{k}" for k in range(1, 7)))


def sliced_table(raw: str, most_chars: int) -> list[str]:
    """A table cut in tables of at most about ``most_chars``, each with the header again."""
    lines = [x for x in raw.split("\n") if x.strip()]
    if len(lines) <= 3:
        return [raw]
    head = lines[:2]
    out, rows, base = [], [], len(head[0]) + len(head[1]) + 2
    size = base
    for row in lines[2:]:
        if rows and size + len(row) > most_chars:
            out.append("\n".join(head + rows))
            rows, size = [], base
        rows.append(row)
        size += len(row) + 1
    return [*out, "\n".join(head + rows)] if rows else out


def packed(found: list[dict], most_tokens: int, flush_tokens: int) -> Iterator[list[dict]]:
    """Runs of blocks within a token budget; large blocks stand alone, large tables are sliced."""
    now: list[dict] = []
    used = 0
    for b in found:
        size = -(-len(b["raw"]) // 4)
        heads = b["kind"] == "heading" and b["depth"] <= 2 and used >= flush_tokens
        if now and (heads or size > most_tokens or used + size > most_tokens):
            yield now
            now, used = [], 0
        if size > most_tokens:
            parts = sliced_table(b["raw"], 4 * most_tokens) if b["kind"] == "table" else [b["raw"]]
            for p in parts:
                yield [b | {"raw": p}]
            continue
        now.append(b)
        used += size
    if now:
        yield now


CHUNKS = "doc_id long, chunk_index int, total_chunks int, title string, breadcrumb string, heading string, heading_level int, kind string, markdown string, embedding_text string, chars long, tokens long, has_code boolean, has_table boolean, has_math boolean, has_diagram boolean, languages array<string>, links array<string>, images array<string>"
_ALONE = {"code_block": "code", "table": "table", "math_block": "math", "mermaid_diagram": "mermaid", "yaml_frontmatter": "frontmatter"}


def document_chunks(text: str, default_title: str, most_tokens: int, flush_tokens: int, with_header: bool) -> list[dict]:
    found = list(Lexer(text).blocks())
    header = flat_yaml(next((b["content"] for b in found if b["kind"] == "yaml_frontmatter"), "") or "")
    title = header.get("title") or next((b["content"] for b in found if b["kind"] == "heading" and b["depth"] == 1 and b["content"]), "") or default_title
    open_: list[tuple[int, str]] = []
    for b in found:
        if b["kind"] == "heading":
            open_ = [x for x in open_ if x[0] < b["depth"]] + [(b["depth"], b["content"])]
        b["open"] = open_
    out = []
    for run in packed([b for b in found if with_header or b["kind"] != "yaml_frontmatter"], most_tokens, flush_tokens):
        path = [h for _, h in run[0]["open"]]
        markdown = "\n\n".join(b["raw"] for b in run)
        crumbs = " > ".join(path) or title
        lines = [f"Document: {title}"] + ([f"Path: {crumbs}"] if crumbs != title else []) + ([f"Tags: {header['tags']}"] if header.get("tags") else [])
        kinds = {b["kind"] for b in run}
        out.append({
            "chunk_index": len(out), "title": title, "breadcrumb": crumbs, "heading": path[-1] if path else title, "heading_level": run[0]["open"][-1][0] if path else 0,
            "kind": _ALONE.get(run[0]["kind"], "composite") if len(run) == 1 else "composite", "markdown": markdown, "embedding_text": "\n".join(lines) + "\n---\n" + markdown,
            "chars": len(markdown), "tokens": -(-len(markdown) // 4), "has_code": "code_block" in kinds, "has_table": "table" in kinds, "has_math": "math_block" in kinds, "has_diagram": "mermaid_diagram" in kinds,
            "languages": list(dict.fromkeys(b["language"] for b in run if b["kind"] == "code_block" and b["language"])),
            "links": list(dict.fromkeys(x for b in run for x in b["links"])), "images": list(dict.fromkeys(x for b in run for x in b["images"])),
        })
    return [c | {"total_chunks": len(out)} for c in out]


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_tokens: int = 800, flush_tokens: int = 150, default_title: str = "Untitled Document", with_header: bool = True) -> DataFrame:
    """Chunks for a vector store: lexing, breadcrumbs and packing of each document in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, ints, lists = pa.string(), pa.int32(), pa.list_(pa.string())
        kinds = {"string": text, "int": ints, "long": pa.int64(), "boolean": pa.bool_(), "array<string>": lists}
        schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in CHUNKS.split(", "))])
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = [{"doc_id": d.as_py(), **c} for d, t in zip(part.column(0), part.column(1), strict=True) for c in document_chunks(t.as_py() or "", default_title, most_tokens, flush_tokens, with_header)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, CHUNKS)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no from 1, line, is_fence, in_fence): lines with the parity of the fences before."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
    fence = F.trim(F.regexp_replace("line", r"^\s+", "")).startswith("```")
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("is_fence", fence).select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line", "is_fence", (F.coalesce(F.sum(F.col("is_fence").cast("int")).over(before), F.lit(0)) % 2 == 1).alias("in_fence"))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", deepest: int = 6) -> DataFrame:
    """(doc_id, section, level, title, slug, start_line, content) of what headings outside fences open.

    Lines before the first heading belong to an introduction only if the text starts with them.
    """
    all_ = lines(docs, id_col, text_col)
    m = F.col("line").rlike(rf"^#{{1,{deepest}}}\s+.+$") & ~F.col("is_fence") & ~F.col("in_fence")
    to_here = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cut = all_.withColumn("heads", m).withColumn("section", F.sum(F.col("heads").cast("int")).over(to_here))
    head = F.max(F.when(F.col("heads"), F.struct(F.length(F.regexp_extract("line", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("line", r"^#+\s+(.+)$", 1)).alias("title"), "line_no")))
    body = F.array_sort(F.collect_list(F.when(~F.col("heads"), F.struct("line_no", "line"))))
    grouped = cut.groupBy("doc_id", "section").agg(head.alias("head"), body.alias("body"))
    title = F.coalesce("head.title", F.lit("Introduction"))
    return grouped.select("doc_id", F.col("section").cast("long").alias("section"), F.coalesce("head.level", F.lit(1)).alias("level"), title.alias("title"), T.slug_section(title).alias("slug"), F.coalesce("head.line_no", F.lit(1)).cast("long").alias("start_line"), F.array_join(F.transform("body", lambda x: x["line"]), "\n").alias("content"))


def outline(found: DataFrame) -> DataFrame:
    """The headings of blocks."""
    return found.where("kind = 'heading'").select("doc_id", "ord", "depth", F.col("content").alias("title"))


def _from_lines(docs: DataFrame, pattern: str, group: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, match) of a pattern outside fences and inline code."""
    clear = lines(docs, id_col, text_col).where(~F.col("is_fence") & ~F.col("in_fence"))
    masked = F.regexp_replace("line", r"`[^`]+`", " ")
    return clear.select("doc_id", "line_no", F.explode(F.regexp_extract_all(masked, F.lit(pattern), F.lit(group))).alias("match"))


def wikilinks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, target, alias)."""
    found = _from_lines(docs, r"(\[\[[^\]|]+(?:\|[^\]]+)?\]\])", 1, id_col, text_col)
    return found.select("doc_id", "line_no", F.trim(F.regexp_extract("match", r"\[\[([^\]|]+)", 1)).alias("target"), F.nullif(F.trim(F.regexp_extract("match", r"\|([^\]]+)\]\]", 1)), F.lit("")).alias("alias"))


def markdown_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, label, url, is_relative)."""
    found = _from_lines(docs, r"(\[[^\]]+\]\([^)]+\))", 1, id_col, text_col)
    url = F.trim(F.regexp_extract("match", r"\]\(([^)]+)\)$", 1))
    return found.select("doc_id", "line_no", F.trim(F.regexp_extract("match", r"^\[([^\]]+)\]", 1)).alias("label"), url.alias("url"), (~url.rlike(r"^(?:https?://|#|mailto:)")).alias("is_relative"))


def code_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block, language, start_line, end_line, code) of closed fences."""
    all_ = lines(docs, id_col, text_col)
    number = F.sum(F.when(F.col("is_fence") & ~F.col("in_fence"), 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    inside = all_.withColumn("block", number).where(F.col("is_fence") | F.col("in_fence"))
    grouped = inside.groupBy("doc_id", "block").agg(F.count_if("is_fence").alias("fences"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.min(F.when(F.col("is_fence"), F.struct("line_no", "line")))["line"].alias("opening"), F.array_sort(F.collect_list(F.when(~F.col("is_fence"), F.struct("line_no", "line")))).alias("body"))
    language = F.trim(F.regexp_extract("opening", r"```(.*)$", 1))
    return grouped.where("fences = 2").select("doc_id", F.col("block").cast("long").alias("block"), F.when(language == "", "text").otherwise(language).alias("language"), "start_line", "end_line", F.array_join(F.transform("body", lambda x: x["line"]), "\n").alias("code"))


def directives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, title, content) of ``:::kind title`` ... ``:::``."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(text_col, F.lit(r"(?ms)^\s*(:::[ \t]*[A-Za-z0-9_-]+[^\n]*\n.*?)^\s*:::[ \t]*$"), F.lit(1))).alias("m"))
    return found.select("doc_id", F.lower(F.regexp_extract("m", r"^:::[ \t]*([A-Za-z0-9_-]+)", 1)).alias("kind"), F.nullif(F.trim(F.regexp_extract("m", r"^:::[ \t]*[A-Za-z0-9_-]+([^\n]*)", 1)), F.lit("")).alias("title"), F.regexp_replace(F.regexp_extract("m", r"(?s)^[^\n]*\n(.*)$", 1), r"\n$", "").alias("content"))


def page_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, page, text) by ``--- PAGE n ---`` markers; a text without any is page 1."""
    parts = F.split(text_col, r"--- PAGE \d+ ---")
    numbers = F.regexp_extract_all(F.col(text_col), F.lit(r"--- PAGE (\d+) ---"), F.lit(1))
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    pages = F.when(F.size(numbers) == 0, F.array(F.struct(F.lit(1).cast("long").alias("page"), trim(F.col(text_col)).alias("text")))).otherwise(F.transform(numbers, lambda n, i: F.struct(n.cast("long").alias("page"), trim(F.get(parts, i + 1)).alias("text"))))
    return docs.where(F.length(trim(F.col(text_col))) > 0).select(F.col(id_col).alias("doc_id"), F.explode(pages).alias("x")).select("doc_id", "x.page", "x.text")


def windows(pages: DataFrame, doc: str, order: str, body: Column, size: int = 8, overlap: int = 2) -> DataFrame:
    """(doc, window, n_windows, first_page, last_page, text) of overlapping runs of a document's pages.

    A page's position gives the windows that hold it, so pages are exploded to their windows and
    grouped; nothing is joined.
    """
    step = size - overlap
    in_doc = Window.partitionBy(doc)
    placed = pages.select(F.col(doc).alias("doc"), F.col(order).alias("page"), body.alias("body")).withColumn("at", F.row_number().over(Window.partitionBy("doc").orderBy("page")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("doc")))
    count = F.when(F.col("n") <= size, 1).otherwise(F.ceil((F.col("n") - size) / step) + 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - size + 1) / step))
    last = F.least(F.floor(F.col("at") / step), F.col("n_windows") - 1)
    held = placed.withColumn("n_windows", count.cast("long")).select("*", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("window"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit("--- PAGE "), F.col("page"), F.lit(" ---\n"), F.col("body")).alias("t")))), lambda x: x["t"]), "\n\n")
    return held.groupBy("doc", "window", "n_windows").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), text.alias("text")).withColumnRenamed("doc", doc)


def frontmatter(kind: Column, title: Column, description: Column, tags: Column, depends_on: Column, weight: Column | None = None, trust_tier: Column | None = None) -> Column:
    """The YAML header of a concept."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    listed = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(name + ":\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("  - "), x)), "\n")))
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit("type: "), kind), F.concat(F.lit("title: "), quoted(title)), F.concat(F.lit("description: "), quoted(description)), F.lit("status: stable"), F.concat(F.lit("trust-tier: "), trust_tier if trust_tier is not None else F.lit("machine-confirmed")), F.concat(F.lit("precedence-weight: "), weight) if weight is not None else F.lit(None).cast("string"), listed("tags", tags), listed("depends-on", depends_on), F.lit("---"))


def concepts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_of: str = "2026-01-01", stale_days: int = 180) -> DataFrame:
    """Concepts from documents: a row for each section of the first two levels, with type, slug, path and trust columns."""
    cut = sections(docs, id_col, text_col, deepest=2).where(F.length(F.trim("content")) > 0)
    kind = T.section_type(F.col("title"), F.col("content"))
    base = cut.select("doc_id", "section", "title", F.col("content").alias("body"), kind.alias("type")).withColumn("slug", T.slug_words(F.col("title")))
    n = F.row_number().over(Window.partitionBy("doc_id", "type", "slug").orderBy("section"))
    numbered = base.withColumn("n", n).withColumn("slug", F.when(F.col("n") > 1, F.concat("slug", F.lit("-"), F.col("n"))).otherwise(F.col("slug")))
    return numbered.select(
        F.concat(F.col("doc_id"), F.lit("/"), "slug").alias("id"), F.concat(F.col("type"), F.lit("s/"), "slug", F.lit(".md")).alias("path"), "doc_id", "section", "title", "type", "body",
        T.description(F.col("title"), F.col("body")).alias("description"), T.subject_tags(F.col("title"), F.col("body")).alias("tags"), F.lit("stable").alias("status"), F.lit("machine-confirmed").alias("trust_tier"),
        F.date_add(F.lit(as_of).cast("date"), stale_days).alias("stale_after"),
    )
