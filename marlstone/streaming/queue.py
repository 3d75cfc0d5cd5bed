"""A conversion queue as a stateful stream: a state for each bucket of documents, retries by timers, resumed from its checkpoint.

Events name a document and what is asked: ``document`` puts it into the queue, ``retry`` takes up one that
failed, ``restart`` converts it again whatever its state. A document that has succeeded is not converted by
another ``document`` event. A failed conversion is tried again after ``backoff_ms`` times the attempts made,
by a timer of the state, up to ``max_attempts``; then the document is an error until a retry. One
document's failure holds up no other.

Documents are dealt to ``buckets`` by a hash of their id, and a bucket is one group of the stream: what a
group costs by itself is paid for many documents together. A bucket is read and written whole when one of
its documents changes, so there should be more of them where there are very many documents; their number
stays with the checkpoint.

Stopping the query pauses the queue, starting it with the same checkpoint resumes it: states, waiting timers
and what was read are kept there. Every batch's transitions are written under its number, so a
batch that is repeated after a lost executor or driver replaces itself. A state holds a text only while
an attempt is due or may be asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.streaming.ingest import totals

_OUT = "doc_id long, step int, status string, attempts int, error string, markdown string"
_STATE = "documents array<struct<doc_id:long,status:string,attempts:int,error:string,text:string,due:long>>"
_COLUMNS = ["doc_id", "step", "status", "attempts", "error", "markdown"]


@dataclass
class _Document:
    """A document of a bucket; ``due`` is the time in milliseconds of its next attempt while it is pending."""

    doc_id: int
    status: str
    attempts: int
    error: str | None
    text: str | None
    due: int


def transitions(events: DataFrame, convert: Callable[[str], str], max_attempts: int = 4, backoff_ms: int = 1500, buckets: int = 2048) -> DataFrame:
    """(doc_id, step, status, attempts, error, markdown) of every change of a document's state.

    events: a stream of doc_id, kind, text and ord, the order of events of one document in a batch.
    Statuses: pending, success, error. Events without an id, of unknown kinds, and retries of what
    has not failed change nothing; a null text is converted as an empty one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        held = {d[0]: _Document(*d) for d in (state.get[0] if state.exists else ())}
        out: list[tuple] = []
        said: dict[int, int] = {}

        def say(d: _Document, markdown: str | None = None) -> None:
            said[d.doc_id] = said.get(d.doc_id, -1) + 1
            out.append((d.doc_id, said[d.doc_id], d.status, d.attempts, d.error, markdown))

        if not state.hasTimedOut:
            asked = pd.concat(list(batches)).sort_values("ord", kind="stable")
            for i, kind, given in zip(asked["doc_id"].tolist(), asked["kind"], asked["text"], strict=True):
                d = held.get(i)
                if (kind == "document" and (d is None or d.status != "success")) or kind == "restart":
                    given = "" if given is None or given != given else given  # null comes as None or NaN
                    d = held[i] = _Document(i, "pending", 0, None, given, now)
                    say(d)
                elif kind == "retry" and d is not None and d.status == "error":
                    d.status, d.attempts, d.error, d.due = "pending", 0, None, now
                    say(d)
        for d in held.values():
            if d.status != "pending" or d.due > now:
                continue
            d.attempts += 1
            try:
                markdown = convert(d.text)
                d.status, d.error, d.text = "success", None, None
                say(d, markdown)
            except Exception as e:  # whatever a conversion raises is the document's error
                d.status, d.error = ("pending" if d.attempts < max_attempts else "error"), str(e)[:500]
                d.due = now + max(1, backoff_ms * d.attempts)
                say(d)
        if held:
            state.update(([astuple(d) for d in held.values()],))
        waiting = [d.due for d in held.values() if d.status == "pending"]
        if waiting:
            state.setTimeoutDuration(max(1, min(waiting) - now))
        yield pd.DataFrame(out, columns=_COLUMNS)

    known = events.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "kind", F.col("text").cast("string"), F.col("ord").cast("long"))
    dealt = known.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if max_attempts > 1 else GroupStateTimeout.NoTimeout)


def run_queue(events: DataFrame, output: str, checkpoint: str, convert: Callable[[str], str], max_attempts: int = 4, backoff_ms: int = 1500, interval: str | None = "1 second", buckets: int = 2048) -> StreamingQuery:
    """Start or resume the queue; transitions go to ``output`` by batch. Without an interval it ends when all present events are read,
    which needs ``max_attempts`` of 1, as timers have no end."""
    if interval is None and max_attempts > 1:
        raise ValueError("a queue with retries needs an interval")
    totals(events.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch={number}")

    found = transitions(events, convert, max_attempts, backoff_ms, buckets)
    return found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()


def queue_log(spark: SparkSession, output: str) -> DataFrame:
    """All transitions, with their batch."""
    return spark.read.option("basePath", output).schema(_OUT + ", batch long").parquet(output)


def queue_table(spark: SparkSession, output: str) -> DataFrame:
    """(doc_id, status, attempts, error, markdown) of each document now."""
    last = Window.partitionBy("doc_id").orderBy(F.desc("batch"), F.desc("step"))
    return queue_log(spark, output).withColumn("n", F.row_number().over(last)).where("n = 1").select("doc_id", "status", "attempts", "error", "markdown")
