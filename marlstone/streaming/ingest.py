"""Streaming ingest of a document folder, with upserts by id and progress counters."""

from __future__ import annotations

import threading
import time as clock

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from marlstone.session import delete


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, at timestamp", files_per_batch: int = 16) -> DataFrame:
    """New parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def latest(rows: DataFrame, key: str = "doc_id", order: str = "at") -> DataFrame:
    """The last row of each key; of equal times the one with the largest hash of all its columns."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(F.xxhash64(*sorted(rows.columns)))))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def upsert_into(stream: DataFrame, table: str, checkpoint: str, key: str = "doc_id", order: str = "at", buckets: int = 64) -> StreamingQuery:
    """Upserts each batch into a table of parquet files; runs until all present files are read.

    The table is partitioned by a bucket of the key, and a batch rewrites only the buckets that
    it touches. A batch is written under its number, so that a repeated one replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # The batch is read once, into a staged table, and everything else starts from there.
        arrived = f"{table.rstrip('/')}_arrived/{number}"
        latest(batch, key, order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.mode("overwrite").parquet(arrived)
        new = spark.read.parquet(arrived)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
        if not touched:
            return
        try:
            old = spark.read.parquet(table).where(F.col("bucket").isin(touched))
            merged = latest(old.select(*new.columns).unionByName(new), key, order)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            merged = new
        staged = f"{table.rstrip('/')}_staged/{number}"
        merged.write.mode("overwrite").parquet(staged)
        # The staged copies of a batch are read by no other batch.
        spark.read.parquet(staged).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
        delete(spark, staged)
        delete(spark, arrived)

    totals(stream.sparkSession)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "10 minutes", lateness: str = "30 minutes") -> DataFrame:
    """Events of each key and window; rows later than the watermark are left out."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


class Totals(StreamingQueryListener):
    """Batches, rows and rates of every run of a query, summed as batches end: a query itself keeps its last hundred."""

    def __init__(self) -> None:
        self.seen: dict[str, dict] = {}
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self.changed:
            self.seen.setdefault(str(event.runId), {"batch": -1, "batches": 0, "rows": 0, "seconds": 0.0, "rows_per_second": 0.0})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.changed:
            t = self.seen.setdefault(str(p.runId), {"batch": -1, "batches": 0, "rows": 0, "seconds": 0.0, "rows_per_second": 0.0})
            if p.batchId > t["batch"]:
                t["batch"] = p.batchId
                t["batches"] += 1
                t["rows"] += p.numInputRows
                t["seconds"] += p.batchDuration / 1000
                t["rows_per_second"] = max(t["rows_per_second"], p.processedRowsPerSecond or 0.0)
            self.changed.notify_all()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


_listeners: dict[str, Totals] = {}


def totals(spark: SparkSession) -> Totals:
    """The session's totals; the first call begins to count."""
    key = spark.sparkContext.applicationId
    if key not in _listeners:
        _listeners[key] = Totals()
        spark.streams.addListener(_listeners[key])
    return _listeners[key]


def progress(query: StreamingQuery, wait: float = 5.0) -> dict[str, float]:
    """Batches and rows read so far by this run of a query, the best rate of a batch, and rows a second of the time
    that batches took (0.1 s at least).

    Events come a little after their batches: up to ``wait`` seconds are given to the last one. Queries that
    began before ``totals`` counted are summed over what they keep, their last hundred batches.
    """
    last = query.lastProgress
    listener = next(iter(_listeners.values()), None)
    if listener is None or query.runId not in listener.seen:
        seen = query.recentProgress
        rows, seconds = sum(p["numInputRows"] for p in seen), sum(p["batchDuration"] for p in seen) / 1000
        return {"batches": len(seen), "rows": rows, "rows_per_second": max([p.get("processedRowsPerSecond") or 0.0 for p in seen], default=0.0), "mean_rate": rows / max(seconds, 0.1)}
    end = clock.monotonic() + wait
    with listener.changed:
        while last and listener.seen[query.runId]["batch"] < last["batchId"] and clock.monotonic() < end:
            listener.changed.wait(0.1)
        t = dict(listener.seen[query.runId])
    return {"batches": t["batches"], "rows": t["rows"], "rows_per_second": t["rows_per_second"], "mean_rate": t["rows"] / max(t["seconds"], 0.1)}
