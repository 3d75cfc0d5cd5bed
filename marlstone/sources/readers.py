"""Sources: files of many kinds to (path, text) rows, tables to Markdown, archives and lexicons."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import web
from marlstone.session import bound_batches

TEXT_ENDINGS = ("md", "txt", "json", "xml", "yaml", "yml", "log", "rst")
_LEXICON = "name string, aliases array<string>, category string, salience double, enabled boolean"


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def split_csv_line(line: str) -> list[str]:
    """Cells of a line; both kinds of quotation marks open and close a quoted part."""
    cells, now, quoted = [], [], False
    for c in line:
        if c in "\"'":
            quoted = not quoted
        elif c == "," and not quoted:
            cells.append("".join(now).strip())
            now = []
        else:
            now.append(c)
    return [*cells, "".join(now).strip()]


def csv_to_markdown(text: str) -> str:
    """A Markdown table of a CSV text; rows are padded or cut to the header's width."""
    lines = [x for x in (text or "").splitlines() if x.strip()]
    if not lines:
        return ""
    head = split_csv_line(lines[0])
    rows = [(split_csv_line(x) + [""] * len(head))[: len(head)] for x in lines[1:]]
    show = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([show(head), "| " + " | ".join(["---"] * len(head)) + " |", *map(show, rows)])


def table_markdown(df: DataFrame, columns: list[str], group: list[str], order: list[str]) -> DataFrame:
    """(group, markdown): the rows of a table as a Markdown table for each group, natively."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n")
    return df.groupBy(*group).agg(F.concat(F.lit(head), rows).alias("markdown"))


def _converted(name: str, raw: bytes) -> tuple[str, str]:
    """(kind, text) of one file; an unknown kind gives no text."""
    kind = name.rpartition(".")[2].lower()
    if kind in ("html", "htm", "xhtml"):
        return "html", web.html_to_markdown(raw.decode("utf-8", "replace"))[2]
    if kind == "csv":
        return "csv", csv_to_markdown(raw.decode("utf-8", "replace"))
    if kind in TEXT_ENDINGS:
        return "text", raw.decode("utf-8", "replace")
    return "other", ""


def convert_files(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, kind, text, error) of files; the members of ZIP archives are files of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    if p.lower().endswith(".zip"):
                        with zipfile.ZipFile(io.BytesIO(c)) as z:
                            rows += [(f"{p}!{n}", *_converted(n, z.read(n)), None) for n in z.namelist() if not n.endswith("/")]
                    else:
                        rows.append((p, *_converted(p, c or b""), None))
                except (zipfile.BadZipFile, OSError, ValueError) as e:  # a broken file is a row with its error
                    rows.append((p, "other", "", str(e)[:200]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*rows, strict=True) if rows else [[]] * 4)], ["path", "kind", "text", "error"])

    bound_batches(files.sparkSession)
    return files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInArrow(run, "path string, kind string, text string, error string")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder, converted."""
    return convert_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon from JSON lines or a CSV with headers; other names of the columns are known."""
    if path.lower().endswith(".csv"):
        raw = spark.read.option("header", "true").csv(path)
    else:
        raw = spark.read.option("multiLine", "true").json(path)
    names = {c.lower().replace("_", "").replace(" ", ""): c for c in raw.columns}

    def pick(*others: str) -> Column:
        return next((F.col(names[o]) for o in others if o in names), F.lit(None))

    aliases = pick("aliases", "alias", "synonyms")
    held = next((names[o] for o in ("aliases", "alias", "synonyms") if o in names), None)
    if held and dict(raw.dtypes)[held] == "string":
        aliases = F.filter(F.transform(F.split(aliases, r"[;|]"), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select(
        F.trim(pick("canonicalname", "name", "term", "entity").cast("string")).alias("name"), aliases.cast("array<string>").alias("aliases"), F.coalesce(pick("category", "type").cast("string"), F.lit("concept")).alias("category"),
        F.coalesce(pick("basesalience", "salience", "weight").cast("double"), F.lit(0.85)).alias("salience"), F.coalesce(pick("enabled", "active").cast("boolean"), F.lit(True)).alias("enabled"),
    ).where("name IS NOT NULL AND name != ''")


def merge_lexicons(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by lower-case name: new fields win where they are set; ``state`` tells added, updated or kept."""
    a, b = old.withColumn("k", F.lower("name")).alias("a"), new.withColumn("k", F.lower("name")).alias("b")
    columns = [c for c in old.columns if c in new.columns]
    state = F.when(F.col("a.k").isNull(), "added").when(F.col("b.k").isNull(), "kept").otherwise("updated")
    return a.join(b, F.col("a.k") == F.col("b.k"), "full_outer").select(*(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in columns), state.alias("state"))


def without_presets(lexicon: DataFrame, presets: DataFrame) -> DataFrame:
    """Entries whose name is none of the presets', in any case."""
    return lexicon.join(presets.select(F.lower("name").alias("k")).distinct(), F.lower(F.col("name")) == F.col("k"), "left_anti")


def with_presets(lexicon: DataFrame, presets: DataFrame) -> DataFrame:
    """The lexicon with the presets that it lacks."""
    return without_presets(presets, lexicon).unionByName(lexicon)


def upsert_history(history: DataFrame, items: DataFrame, most: int = 50) -> DataFrame:
    """The newest ``most`` items, each id once with its latest row; both hold id and at."""
    every = history.unionByName(items)
    latest = every.groupBy("id").agg(F.max_by(F.struct(*every.columns), "at").alias("r")).select("r.*")
    return latest.orderBy(F.desc("at"), "id").limit(most)


def lines_to_markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, markdown) of plain extracted lines: short title-case lines become headings, bullets items."""
    each = F.transform(F.split(text_col, "\n"), lambda x: F.trim(x))

    def line(x: Column) -> Column:
        heading = x.rlike(r"(?i)^(?:abstract|introduction|background|methods?|results|discussion|conclusions?|references|summary)$") | (F.length(x).between(4, 60) & x.rlike(r"^(?:[A-Z][\w'-]*\s*){1,8}$"))
        return F.when(x == "", "").when(x.rlike(r"^[•●▪*-]\s*"), F.concat(F.lit("- "), F.regexp_replace(x, r"^[•●▪*-]\s*", ""))).when(heading, F.concat(F.lit("## "), x)).otherwise(x)

    return docs.select(F.col(id_col).alias("doc_id"), F.array_join(F.transform(each, line), "\n").alias("markdown"))


def page_text(items: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, page, text) of glyph runs (doc_id, page, x, y, text): lines from top to bottom, runs from left to right.

    Heights are folded from the top: a run opens a line where it lies more than ``tolerance`` below the run
    that opened the line before it, whatever the distance to its neighbour. Runs of one place go by their text.
    Empty runs are left out; runs without a place stand at 0. A page's runs meet in one row.
    """
    placed = items.where("text IS NOT NULL AND text <> ''").select("doc_id", "page", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"), F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y"), F.trim("text").alias("text"))
    pages = placed.groupBy("doc_id", "page").agg(F.collect_list(F.struct("y", "x", "text")).alias("runs"), F.sort_array(F.collect_set("y"), asc=False).alias("heights"))
    opens = lambda anchors, y: (F.size(anchors) == 0) | (F.element_at(anchors, -1) - y > tolerance)
    anchors = F.aggregate("heights", F.expr("cast(array() as array<double>)"), lambda acc, y: F.when(opens(acc, y), F.concat(acc, F.array(y))).otherwise(acc))
    line = lambda r: F.size(F.filter("anchors", lambda a: a >= r["y"]))
    sorted_runs = F.array_sort(F.transform("runs", lambda r: F.struct(line(r).alias("line"), r["x"].alias("x"), r["text"].alias("text"))))
    joined = F.array_join(F.transform(F.sequence(F.lit(1), F.size("anchors")), lambda n: F.array_join(F.transform(F.filter("placed", lambda r: r["line"] == n), lambda r: r["text"]), " ")), "\n")
    return pages.withColumn("anchors", anchors).withColumn("placed", sorted_runs).select("doc_id", "page", joined.alias("text"))


def paged_text(items: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, n_pages, text): the pages of each document under marks with their numbers."""
    part = F.struct("page", F.concat(F.lit("--- PAGE "), F.col("page").cast("string"), F.lit(" ---\n\n"), "text").alias("text"))
    pages = page_text(items, tolerance).groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return pages.select("doc_id", F.size("parts").cast("long").alias("n_pages"), F.trim(F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")).alias("text"))


def two_columns(items: DataFrame, width: float) -> DataFrame:
    """(doc_id, page, two_columns): whether more than six in ten runs lie clearly left or right of the middle."""
    left, right = F.count_if(F.col("x") < 0.4 * width), F.count_if(F.col("x") > 0.55 * width)
    return items.groupBy("doc_id", "page").agg(((left + right) / F.count("*") > 0.6).alias("two_columns"))


def selection_totals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: documents, words, characters, bytes and estimated tokens."""
    t = F.col(text_col)
    return docs.agg(F.count("*").alias("n_docs"), F.sum(T.word_count(t)).alias("words"), F.sum(F.length(t)).cast("long").alias("chars"), F.sum(F.octet_length(t)).cast("long").alias("bytes"), F.sum(T.tokens_by_words_rounded(t)).cast("long").alias("tokens"))
