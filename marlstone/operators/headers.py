"""Document headers between ``---`` lines, as VARIANT, and documents parsed whole.

Two readings of a header beside the flat one of ``markdown.py``:

``typed``: lines of ``key: value`` and dashed items below a key, whatever the indentation. Numbers,
booleans and inline lists are typed (items of inline lists stay text); what follows ``#`` is dropped, in quotes too.

``nested``: mappings and sequences by indentation, kept on a stack; inline lists and mappings, quoted text, ``|`` and ``>``
blocks, comments, numbers, booleans and nulls. Dates stay text. Anchors, tags and
several documents are not read: such a header, or one that is malformed, gives an empty mapping and its error.

A header is a few lines, so it is parsed in one narrow pass over Arrow batches; ``variant_get`` reads it from there on.
A text without a closed header is a body as it stands.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import markdown
from marlstone.session import bound_batches, durable

_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`][^:#]*?|[^\s:#]+?)\s*:(?:\s+(.*)|)$""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/"}


def _number(text: str) -> int | float:
    return int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)


def typed_yaml(text: str) -> dict:
    """Key and value lines with typed values; a dashed item goes to the last key."""
    out: dict = {}
    key, items = "", None

    def value(v: str):
        if v in ("true", "false"):
            return v == "true"
        if _NUMBER.fullmatch(v):
            return _number(v)
        if v.startswith("[") and v.endswith("]"):
            return [re.sub(r"^[\"']|[\"']$", "", s.strip()) for s in v[1:-1].split(",")]
        return re.sub(r"^[\"']|[\"']$", "", v)

    for line in (text or "").split("\n"):
        line = line.partition("#")[0].strip()
        if line.startswith("- ") and key:
            if items is None:
                items = out[key] = []
            items.append(value(line[2:].strip()))
        elif ":" in line:
            name, _, rest = line.partition(":")
            key, items = name.strip(), None
            out[key] = value(rest.strip()) if rest.strip() else None
    return out


class _Nested:
    """Lines by indentation; ``at`` is the next line."""

    def __init__(self, text: str) -> None:
        self.raw = text.replace("\r\n", "\n").split("\n")
        self.at = 0

    def _skip(self) -> None:
        while self.at < len(self.raw) and (not self.raw[self.at].strip() or self.raw[self.at].lstrip().startswith("#")):
            self.at += 1

    def _indent(self) -> int:
        """Of the next filled line; -1 at the end."""
        self._skip()
        if self.at == len(self.raw):
            return -1
        line = self.raw[self.at]
        if "\t" in line[: len(line) - len(line.lstrip())]:
            raise ValueError(f"tab in the indentation of line {self.at + 1}")
        return len(line) - len(line.lstrip(" "))

    def whole(self):
        found = self.block(0) if self._indent() >= 0 else None
        if self._indent() >= 0:
            raise ValueError(f"line {self.at + 1} stands outside")
        return found

    def block(self, least: int):
        """The value whose lines are indented by ``least`` or more."""
        depth = self._indent()
        if depth < least:
            return None
        line = self.raw[self.at].strip()
        if line == "-" or line.startswith("- "):
            return self._sequence(depth)
        if _KEY.match(self._bare(line)):
            return self._mapping(depth)
        self.at += 1
        return self._scalar(line)

    @staticmethod
    def _bare(line: str) -> str:
        """Without a comment that is not in quotes."""
        quote = ""
        for i, c in enumerate(line):
            if quote:
                quote = "" if c == quote and (quote == "'" or line[i - 1] != "\\") else quote
            elif c in "\"'" and (i == 0 or line[i - 1] in " ,:[{-"):
                quote = c
            elif c == "#" and (i == 0 or line[i - 1] in " \t"):
                return line[:i].rstrip()
        return line.rstrip()

    def _sequence(self, depth: int) -> list:
        out = []
        while self._indent() == depth and (self.raw[self.at].strip() + " ").startswith("- "):
            rest = self.raw[self.at].strip()[1:]
            inner = rest.strip()
            if not self._bare(inner):
                self.at += 1
                out.append(self.block(depth + 1))
            elif (inner + " ").startswith("- ") or _KEY.match(self._bare(inner)):
                # A mapping or sequence that begins beside the dash: its first line moves in.
                column = depth + 1 + len(rest) - len(rest.lstrip())
                self.raw[self.at] = " " * column + inner
                out.append(self.block(column))
            else:
                out.append(self._inline(inner, depth))
        return out

    def _mapping(self, depth: int) -> dict:
        out: dict = {}
        while self._indent() == depth:
            m = _KEY.match(self._bare(self.raw[self.at].strip()))
            if m is None:
                raise ValueError(f"no key in line {self.at + 1}")
            key = str(self._scalar(m[1])) if m[1][0] in "\"'" else m[1].strip()
            if key in out:
                raise ValueError(f"{key} twice")
            if m[2] is None or not m[2].strip():
                self.at += 1
                # A sequence may stand as deep as its key.
                beside = self._indent() == depth and (self.raw[self.at].strip() + " ").startswith("- ")
                out[key] = self._sequence(depth) if beside else self.block(depth + 1)
            else:
                out[key] = self._inline(m[2].strip(), depth)
        if self._indent() > depth:
            raise ValueError(f"line {self.at + 1} is indented too far")
        return out

    def _inline(self, value: str, depth: int):
        """A value beside its key or dash, which may go on in deeper lines."""
        self.at += 1
        if re.fullmatch(r"[|>][+-]?", value):
            return self._text(value, depth)
        if value[0] in "&*!%@`":
            raise ValueError(f"not read: {value[:20]}")
        if value[0] in "[{":
            while not self._closed(value):
                if self.at == len(self.raw):
                    raise ValueError("a bracket stays open")
                value += " " + self._bare(self.raw[self.at].strip())
                self.at += 1
            found, end = self._flow(value, 0)
            if value[end:].strip():
                raise ValueError(f"text behind a bracket: {value[end:][:20]}")
            return found
        if value[0] not in "\"'":
            while self._indent() > depth:  # plain text over lines
                if _KEY.match(self._bare(self.raw[self.at].strip())):
                    raise ValueError(f"line {self.at + 1} is indented too far")
                value += " " + self._bare(self.raw[self.at].strip())
                self.at += 1
        return self._scalar(value)

    def _text(self, mark: str, depth: int) -> str:
        lines = []
        while self.at < len(self.raw) and (not self.raw[self.at].strip() or len(self.raw[self.at]) - len(self.raw[self.at].lstrip(" ")) > depth):
            lines.append(self.raw[self.at])
            self.at += 1
        ends = len(lines)
        while ends and not lines[ends - 1].strip():
            ends -= 1
        blank, lines = len(lines) - ends, lines[:ends]
        margin = min((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), default=0)
        lines = [x[margin:] for x in lines]
        if mark[0] == "|":
            text = "\n".join(lines)
        else:
            text = re.sub(r"\n(\n*)", lambda m: m[1] or " ", "\n".join(lines))
        return text + ("" if mark.endswith("-") or not lines else "\n" * (1 + blank) if mark.endswith("+") else "\n")

    @staticmethod
    def _closed(text: str) -> bool:
        bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", "", text)
        return bare.count("[") + bare.count("{") <= bare.count("]") + bare.count("}")

    def _flow(self, s: str, i: int):
        """(value, place behind it) of an inline list, mapping or scalar."""
        while s[i : i + 1] == " ":
            i += 1
        if s[i : i + 1] in ("[", "{"):
            close, i = ("]" if s[i] == "[" else "}"), i + 1
            items, pairs = [], {}
            while True:
                while s[i : i + 1] in (" ", ","):
                    i += 1
                if i >= len(s):
                    raise ValueError("a bracket stays open")
                if s[i] == close:
                    return (items if close == "]" else pairs), i + 1
                one, i = self._flow(s, i)
                while s[i : i + 1] == " ":
                    i += 1
                if close == "}":
                    value = None
                    if s[i : i + 1] == ":":
                        value, i = self._flow(s, i + 1)
                    pairs[one if isinstance(one, str) else json.dumps(one)] = value
                else:
                    items.append(one)
        quoted = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'").match(s, i)
        m = quoted or re.compile(r"(?:[^,\[\]{}:]|:(?! |$))*").match(s, i)
        return self._scalar(m[0].strip()), m.end()

    def _scalar(self, value: str):
        value = self._bare(value)
        if value[:1] == '"':
            m = re.fullmatch(r'"((?:[^"\\]|\\.)*)"', value)
            if m is None:
                raise ValueError("a quotation stays open")
            return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda e: chr(int(e[1][1:], 16)) if e[1][0] == "u" and len(e[1]) == 5 else _ESCAPES.get(e[1], e[1]), m[1])
        if value[:1] == "'":
            m = re.fullmatch(r"'((?:[^']|'')*)'", value)
            if m is None:
                raise ValueError("a quotation stays open")
            return m[1].replace("''", "'")
        if value in ("", "~", "null", "Null", "NULL"):
            return None
        if value in ("true", "True", "TRUE", "false", "False", "FALSE"):
            return value.lower() == "true"
        return _number(value) if _NUMBER.fullmatch(value) else value


def nested_yaml(text: str):
    """The value of a header; ValueError where it is malformed."""
    return _Nested(text).whole()


def split_header(content: str) -> tuple[str | None, str]:
    """(header, body): a header opens with the text and is closed by a line that begins with ``---``."""
    end = content.find("\n---", 3) if content.startswith("---") else -1
    return (content[3:end].strip(), content[end + 4 :].strip()) if end >= 0 else (None, content)


def parsed_headers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reading: str = "nested") -> DataFrame:
    """(doc_id, header, raw, body, error): header is a VARIANT mapping, empty where there is none; raw its text or null.

    A null text is an empty one. A header that is a list or a single value counts as empty.
    """
    read = {"nested": nested_yaml, "typed": typed_yaml}[reading]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for content in b.column(1):
                raw, body = split_header(content.as_py() or "")
                found, error = {}, None
                if raw is not None:
                    try:
                        found = read(raw)
                    except (ValueError, RecursionError) as e:
                        error = str(e)[:200]
                rows.append((json.dumps(found if isinstance(found, dict) else {}, allow_nan=False) if error is None else "{}", raw, body, error))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 4))], ["doc_id", "json", "raw", "body", "error"])

    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = base.mapInArrow(run, "doc_id string, json string, raw string, body string, error string")
    return found.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), F.parse_json("json").alias("header"), "raw", "body", "error")


def field(header: Column, *names: str) -> Column:
    """The first of a header's fields that is set, as text; lists and mappings as JSON."""
    return F.coalesce(*(F.nullif(F.try_variant_get(header, f'$["{n}"]', "string"), F.lit("")) for n in names))


def parse_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row for each document: doc_id, id, type, title, status, trust_tier, depends_on, header, n_lines, n_words, n_sections, n_wikilinks,
    n_links, n_directives and n_code_blocks. Ids are one to a document.

    Keys with hyphens stand for those with underscores where these are missing. id: the path without ``.md`` and
    leading dots, else the title's slug. Without a given tier a verified document is human-reviewed, any other
    machine-confirmed. Counts are of the body; n_lines of the whole text.
    """
    held = durable(parsed_headers(docs, id_col, text_col))
    h = F.col("header")
    title = field(h, "title")
    slug = F.regexp_replace(F.lower(F.coalesce(title, F.lit("unnamed"))), "[^a-z0-9]+", "-")
    verified = F.coalesce(field(h, "verified_by", "verified-by"), field(h, "verified_at", "verified-at"), F.nullif(field(h, "verified"), F.lit("[]")))
    tier = F.coalesce(field(h, "trustTier", "trust-tier"), F.when(verified.isNotNull(), "human-reviewed").otherwise("machine-confirmed"))
    depends = F.coalesce(F.try_variant_get(h, "$.depends_on", "array<string>"), F.try_variant_get(h, '$["depends-on"]', "array<string>"), F.expr("cast(array() as array<string>)"))
    paths = docs.select(F.col(id_col).alias("doc_id"), F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).cast("long").alias("n_lines"), (F.col(path_col) if path_col else F.lit(None).cast("string")).alias("path"))
    words = F.regexp_count("body", F.lit(r"\S+")).cast("long")
    own = held.select("doc_id", "header", slug.alias("slug"), F.coalesce(field(h, "type"), F.lit("concept")).alias("type"), title.alias("title"), field(h, "status").alias("status"), tier.alias("trust_tier"), depends.alias("depends_on"), words.alias("n_words")).join(paths, "doc_id")
    body = held.select("doc_id", "body")
    parts = {"n_sections": markdown.sections, "n_wikilinks": markdown.wikilinks, "n_links": markdown.markdown_links, "n_directives": markdown.directives, "n_code_blocks": markdown.code_blocks}
    for name, found in parts.items():
        own = own.join(found(body, "doc_id", "body").groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    named = F.when(F.length("path") > 0, F.regexp_replace(F.regexp_replace("path", r"\.md$", ""), r"^[./]+", "")).otherwise(F.col("slug"))
    return own.select("doc_id", named.alias("id"), "type", "title", "status", "trust_tier", "depends_on", "header", "n_lines", "n_words", *parts)
