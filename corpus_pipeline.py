"""The corpus pipeline: drop toxic documents, deduplicate, redact, mix and pack."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import mixing, packing, pii, textkernel, toxicity
from marlstone.llm.jaccard_join import jaccard_components
from marlstone.session import durable, table


_MOST_BROADCAST = 1_000_000  # rows of two longs


def _give_back(spark: SparkSession) -> None:
    """Have the Python workers, which outlive stages, drop what the last stage kept in them and return freed memory.

    A worker that the job misses keeps some memory, and nothing else changes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxicity._in_use.clear()
        textkernel._powers.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
        yield from batches

    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()


def _renamed(docs: DataFrame, *needed: str) -> tuple[DataFrame, tuple[str, ...]]:
    """The columns ``needed`` by name, and all columns under names that no operator uses."""
    kept = tuple(f"__c_{i}" for i in range(len(docs.columns)))
    return docs.select(*needed, *(docs[c].alias(k) for c, k in zip(docs.columns, kept, strict=True))), kept


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The kept columns under their own names."""
    return rows.select(*(F.col(f"__c_{i}").alias(c) for i, c in enumerate(docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, fitted on the given labels, scores below 0.5.

    A null or empty text scores as an empty one; rows with null or repeated ids are judged each by
    its text; columns of any name are kept; an empty table gives an empty one.
    """
    _give_back(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    named, kept = _renamed(docs, "doc_id", "text")
    return _restored(toxicity.score(named, model, kept).where("score < 0.5"), docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links: the one with the smallest id.

    Rows are judged each by its text, also where ids are null (last in order) or repeated; of equal
    ids the row with the smallest hash of all its columns stays, and rows equal in all columns are
    one. Null and empty texts link with nothing and stay. Columns of any name are kept; an empty
    table gives an empty one.
    """
    _give_back(spark)
    named, _ = _renamed(docs, "doc_id", "text")
    keyed = named.withColumn("__row", F.xxhash64(*(F.coalesce(F.col(f"__c_{i}").cast("string"), F.lit("\x00")) for i in range(len(docs.columns))))).drop("text")
    texts = keyed.select("__row", F.col(f"__c_{docs.columns.index('text')}").alias("text"))
    found = jaccard_components(texts, id_col="__row", width=5, percent=80).withColumnRenamed("doc_id", "__row")
    rows = keyed.select("doc_id", "__row").join(found.select("__row", "component_id").distinct(), "__row")
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "__row")).alias("first"), F.count("*").alias("n"))
    winners = first.where("n > 1").select("component_id", F.col("first.__row").alias("kept"))
    # Most documents stay alone: only the rows of groups are shuffled.
    beaten = durable(rows.join(winners, "component_id").select("__row", "kept").distinct())
    _give_back(spark)  # what follows here and in the next two stages runs no Python on the executors
    small = F.broadcast(beaten) if beaten.count() <= _MOST_BROADCAST else beaten
    alone = keyed.join(small.select("__row"), "__row", "left_anti")
    grouped = keyed.join(small.where("__row = kept").select("__row"), "__row", "left_semi").dropDuplicates(["__row"])
    return _restored(alone.unionAll(grouped), docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets.

    Null texts stay null; rows with null or repeated ids are rows of their own; columns of any name
    are kept, and ``n_chars`` follows the text; an empty table gives an empty one.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words: whole copies, and the picked passages of the rest.

    The rows keep the columns of documents. A copy with part of the words holds the passages that
    the mix picked, in order, each word with the white space before it; adjacent ones join as they stood.

    Documents without words (null, empty, blank) have nothing to take and go. Null sources are one
    source; null or repeated ids are rows of their own; columns of any name are kept; an empty table
    gives an empty one.
    """
    named, others = _renamed(docs, "doc_id", "source", "text")
    body = f"__c_{docs.columns.index('text')}"
    mixed = mixing.mix(named, extra=others, passages=True)
    whole = F.floor(F.col("taken") / F.greatest(F.lit(1), F.col("size"))).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    parts = mixed.where("taken > 0").select(*others, "passages", F.explode(F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.expr("cast(array() as array<int>)")))).alias("words"))
    words = F.regexp_extract_all(body, F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    # The array of one binds the words, so that each passage reads them ready.
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("passages", lambda p: F.slice(w, p["start"] + 1, p["words"]))), ""))
    out = _restored(parts.withColumn(body, F.when(F.col("words") < 0, F.col(body)).otherwise(F.get(cut, F.lit(0)))), docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.

    Null texts are empty documents of one end id; null or repeated ids are packed as any other;
    other columns are left; an empty table gives an empty one.
    """
    _give_back(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each),
    ("pii", redact),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The fitted and the iterative stages cannot be written in SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
