"""Labelled rows: joined without shuffling the texts that have no label."""

import pytest
from pyspark.sql import functions as F

from marlstone.llm import labelled, toxicity
from marlstone.llm.labelled import fold, training_rows


@pytest.fixture
def tables(spark):
    ids = F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 5 == 0, -F.col("id")).otherwise(F.col("id") % 1900)
    docs = spark.range(2000).select(ids.alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(400).select(F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 2 == 0, -5 * F.col("id")).otherwise(F.col("id") % 300).alias("doc_id"), F.when(F.col("id") % 7 > 0, (F.col("id") % 3 == 0).cast("int")).alias("toxic"))
    return docs, labels


def _expected(docs, labels):
    usable = [r for r in labels.where(fold() != 0).collect() if r["toxic"] is not None]
    largest = {i: max(r["toxic"] for r in usable if r["doc_id"] == i) for i in {r["doc_id"] for r in usable}}
    return sorted((r["doc_id"], r["text"], largest[r["doc_id"]]) for r in docs.collect() if r["doc_id"] in largest)


def test_texts_stay_where_they_are_read(spark, tables):
    docs, labels = tables
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # labels that Spark would not broadcast of itself
    try:
        found = training_rows(docs, labels, "toxic", 0)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan, plan
        assert sorted(map(tuple, found.collect())) == _expected(docs, labels)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("marks", [1, 64, 1 << 15, 1 << 26])
def test_labels_beyond_a_broadcast(tables, monkeypatch, marks):
    docs, labels = tables
    monkeypatch.setattr(labelled, "_MOST_BROADCAST", -1)
    monkeypatch.setattr(labelled, "_MARKS", marks)
    assert sorted(map(tuple, training_rows(docs, labels, "toxic", 0).collect())) == _expected(docs, labels)


def test_marks_keep_unlabelled_texts_out_of_the_shuffle(spark):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    ids = spark.range(0, 100_000, 7).withColumnRenamed("id", "doc_id")
    near = labelled._near(docs, ids)
    assert near.join(ids, "doc_id").count() == ids.count()
    assert ids.count() <= near.count() < 1.01 * ids.count()


def test_fit_is_the_same_beyond_a_broadcast_and_leaves_no_texts(spark, monkeypatch, tmp_path):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "you grumblefoot, you snarkwort").otherwise("a quiet day in town").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    want = toxicity.fit(docs, labels)
    monkeypatch.setattr(labelled, "_MOST_BROADCAST", -1)
    monkeypatch.setattr("marlstone.session.shared_dir", lambda spark: str(tmp_path))
    got = toxicity.fit(docs, labels)
    assert (got.terms, got.stems) == (want.terms, want.stems) and got.terms
    assert abs(got.weights - want.weights).max() < 1e-9
    assert [t for t in tmp_path.iterdir() if {"text", "word", "hits"} & set(spark.read.parquet(str(t)).columns)] == []


def test_long_texts_are_read_a_few_at_a_time(spark, tables):
    docs, labels = tables
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    toxicity.score(docs, toxicity.fit(docs, labels))
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256
