"""The labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import durable

_MOST_BROADCAST = 1_000_000  # rows of a long and an int
_MARKS = 1 << 26  # bits: 8 MB, whatever the number of ids


def fold(id_col: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def _near(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """All ``rows`` whose doc_id is among ``ids``, and the few others whose hash meets a mark of ``ids``."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(_MARKS))
    place = F.bitmap_bit_position("__slot")
    # Dealt by the bucket first, so that no task makes bitmaps of all buckets.
    dealt = ids.select(slot.alias("__slot")).select("__slot", F.bitmap_bucket_number("__slot").alias("__bucket")).repartition("__bucket")
    marks = dealt.groupBy("__bucket").agg(F.bitmap_construct_agg(place).alias("__marks"))
    met = rows.withColumn("__slot", slot).withColumn("__bucket", F.bitmap_bucket_number("__slot")).join(F.broadcast(marks), "__bucket")
    byte = F.conv(F.hex(F.substring("__marks", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, held_fold: int, max_rows: int | None = None, folds: int = 5) -> DataFrame:
    """(doc_id, text, label) of the labelled rows outside the held-out fold.

    With ``max_rows``, at most so many: those with the smallest hashes of their ids, so reruns
    agree. Ids labelled twice count with their largest label; null labels do not count.

    Texts stay where they are read while the labels, counted, can be broadcast. Beyond that only texts
    that meet a mark of a labelled id are shuffled, once: the rows are written and read again.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    usable = named.where("doc_id IS NOT NULL AND label IS NOT NULL").where(fold() != held_fold)
    once = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if max_rows is None:
        once = durable(once)
        if once.count() <= _MOST_BROADCAST:
            return texts.join(F.broadcast(once), "doc_id")
        return durable(_near(texts, once).join(once, "doc_id"))
    # At most max_rows of 12 bytes: a proven bound for the broadcast below.
    chosen = durable(once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    return texts.join(F.broadcast(chosen), "doc_id")
