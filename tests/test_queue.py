"""The conversion queue over stops, restarts and retries, and totals of many batches."""

import os
import time

from marlstone.operators import catalog
from marlstone.streaming import ingest, queue


def add(spark, folder, rows):
    spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, kind string, text string, ord int").coalesce(1).write.mode("append").parquet(folder)


def until(query, ready, seconds=90):
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        assert query.exception() is None
        if ready():
            return
        time.sleep(0.3)
    raise AssertionError("the queue did not come that far")


def test_queue_over_restarts(spark, tmp_path):
    source, out, checkpoint, mended = (str(tmp_path / x) for x in ("in", "out", "cp", "mended"))

    def convert(text):
        if "bad" in text and not os.path.exists(mended):
            raise ValueError(f"no conversion of {text}")
        return f"# {text}"

    def start(backoff):
        events = spark.readStream.schema("doc_id long, kind string, text string, ord int").parquet(source)
        return queue.run_queue(events, out, checkpoint, convert, max_attempts=3, backoff_ms=backoff, interval="0 seconds")

    def now():
        try:
            return {r["doc_id"]: tuple(r)[1:] for r in queue.queue_table(spark, out).collect()}
        except Exception:  # before the first batch
            return {}

    add(spark, source, [(1, "document", "one"), (2, "document", "bad two"), (3, "document", None), (None, "document", "x"), (4, "retry", None), (5, "document", "bad five"), (6, "other", "x")])
    q = start(50)
    until(q, lambda: now().get(2, [None])[0] == "error" and now().get(5, [None])[0] == "error")
    assert now() == {1: ("success", 1, None, "# one"), 2: ("error", 3, "no conversion of bad two", None), 3: ("success", 1, None, "# "), 5: ("error", 3, "no conversion of bad five", None)}
    steps = [(r["status"], r["attempts"]) for r in queue.queue_log(spark, out).where("doc_id = 2").orderBy("batch", "step").collect()]
    assert steps == [("pending", 0), ("pending", 1), ("pending", 2), ("error", 3)]
    q.stop()

    # Stopped: what comes now waits for the resumed query. A timer that is set before a stop goes off after it.
    add(spark, source, [(1, "document", "again"), (7, "document", "bad seven"), (8, "document", "eight"), (8, "restart", "eight b")])
    q = start(4000)
    until(q, lambda: now().get(7, [None])[:2] == ("pending", 1) and 8 in now())
    q.stop()
    assert now()[1] == ("success", 1, None, "# one") and now()[8] == ("success", 1, None, "# eight b")
    open(mended, "w").close()
    add(spark, source, [(2, "retry", None), (1, "retry", None)])
    q = start(50)
    until(q, lambda: now().get(7, [None])[0] == "success" and now()[2][0] == "success")
    q.stop()
    assert now()[7] == ("success", 2, None, "# bad seven") and now()[2] == ("success", 1, None, "# bad two") and now()[5][0] == "error"
    counts = catalog.queue_status(queue.queue_table(spark, out)).first()
    assert (counts["n_total"], counts["n_success"], counts["n_error"], counts["progress"]) == (6, 5, 1, 100)


def test_totals_of_many_batches(spark, tmp_path):
    ingest.totals(spark)
    source = tmp_path / "in"
    source.mkdir()
    for i in range(150):
        (source / f"{i:03d}.txt").write_text("x\n" * (i + 1))
    q = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(source)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = ingest.progress(q)
    assert (got["batches"], got["rows"]) == (150, 150 * 151 // 2) and got["mean_rate"] > 0
    assert len(q.recentProgress) <= 100


def test_upsert_leaves_no_copies(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "t")
    spark.createDataFrame([(i, "a", None) for i in range(20)], "doc_id long, text string, at timestamp").write.parquet(source)
    ingest.upsert_into(ingest.document_stream(spark, source), table, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(table).count() == 20
    assert not [x for d in ("t_arrived", "t_staged") if (tmp_path / d).exists() for x in os.listdir(tmp_path / d)]
