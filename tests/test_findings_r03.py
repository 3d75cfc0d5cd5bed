"""Cases of the third round's findings."""

import math
import random
import time
import tracemalloc

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.llm import pii, toxicity
from marlstone.operators import analysis, catalog, cycles, entities, quality, reader, retrieval, tagger
from marlstone.plans import container_queries
from marlstone.streaming import queue


def test_lone_article_goes_before_the_body():
    box = '<div class="ad">In of the, and on, by it, at last, it ends.</div><div class="box">kept</div><img src="x.png" width="10">'
    words = "Plain words that go on without any mark for a long while " * 10
    page = f"<html><head><title>t</title></head><body>{box}<article><p>{words}</p></article></body></html>"
    markup = reader.read_article(page, "https://example.com/a")["html"]
    assert markup.count("<p>") == 2 and "kept" not in markup and "<img" not in markup
    # Two articles, or one of little text, leave the whole body.
    two = page.replace("<article>", "<article><p>One more of some length, here, it is.</p></article><article>")
    assert "kept" in reader.read_article(two, "https://example.com/a")["html"]


def test_one_digit_as_c_prints_it(spark):
    draw = random.Random(3)
    values = [31.25, 31.35, 0.65, 0.75, 2.25, 2.75, 99.95, 99.96, 100.0, 12.0] + [k / 20 for k in range(10, 2000)] + [draw.uniform(0.5, 100) for _ in range(500)] + [100 * (i / n) for n in range(1, 60) for i in range(1, n + 1) if i / n > 0.005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [(r.v, r.s) for r in df.select("v", T.one_digit(F.col("v")).alias("s")).collect()] == [(v, f"{v:.1f}") for v in values]
    text = "\x07" * 5 + "a" * 11  # 31.25 %
    told = spark.createDataFrame([(text,)], "text string").select(quality.text_complexity(F.col("text"), F.lit(1))["reasons"].alias("r")).first().r
    assert any("(31.2% garbled glyphs)" in r for r in told)


def test_personal_data_is_fitted_on_every_document(spark, monkeypatch):
    seen = []
    fitted = pii.fit_trees
    monkeypatch.setattr(pii, "fit_trees", lambda vectors: seen.extend(vectors) or fitted(vectors))
    docs = spark.range(45_000).selectExpr("id AS doc_id", "'call 415-555-0100 now' AS text")
    pii.fit(pii._prepared(docs))
    assert sum(v["n"] + v["n_held"] for v in seen) == 45_000
    # The stage of the pipeline, which names no operator's columns.
    seen.clear()
    corpus_pipeline.redact(spark, docs, "")
    assert sum(v["n"] + v["n_held"] for v in seen) == 45_000


def test_cycles_are_told_one_by_one():
    n = 1500
    after = {str(i): [str(j) for j in (i + 1, 0) if j < n] for i in range(n)}
    tracemalloc.start()
    assert sum(len(c) for c in cycles._closed(list(after), after)) == sum(i + 2 for i in range(n))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000  # all of them together are above 9 MB


def test_keyphrases_shuffle_no_phrases(spark):
    rows = [(1, "stone river **stone** river lake"), (2, "stone"), (2, "stone wall"), (None, "x"), (3, None), (4, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.rank, r.phrase, r.weight) for r in entities.keyphrases(df).collect())
    weights = {(d, p): w for d, _, p, w in got}
    assert weights == {(1, "stone"): 5.0, (1, "river"): 2.0, (1, "lake"): 1.0, (1, "stone-river"): 5.0, (1, "river-stone"): 2.5, (1, "river-lake"): 2.5, (2, "stone"): 2.0, (2, "wall"): 1.0, (2, "stone-wall"): 2.5}
    assert [p for d, _, p, _ in got if d == 2] == ["stone-wall", "stone", "wall"]
    once = df.where("doc_id = 1")
    assert "Exchange" not in entities.keyphrases(once)._jdf.queryExecution().executedPlan().toString()


def test_patterns_are_matched_once(spark):
    found = entities.pattern_entities(F.col("text"))
    plan = spark.createDataFrame([("REST of 5 ms",)], "text string").select(found.alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 5


def test_reading_figures_take_no_word_by_itself(spark):
    docs = spark.createDataFrame([(1, "The beautiful education is here, aaaab. Queueing!")], "doc_id long, text string")
    found = analysis.reading_figures(docs)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()  # which Spark does not compile
    by_word = spark.createDataFrame([(w,) for w in "the beautiful education is here aaaab queueing".split()], "w string").where(T.syllables(F.col("w")) >= 3).count()
    assert found.first().polysyllable_count == by_word


def test_types_are_told_once_in_the_analysis(spark):
    docs = spark.createDataFrame([(1, "How to", "1. Install it and run it.\n2. You must wait.")], "doc_id long, title string, text string")
    found = catalog.analysed(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("download|click|navigate") == 1
    assert found.first().type == "procedure"


def test_tags_of_a_form_are_told_by_one_test_each(spark):
    text = "The viable running of `12 ms` and `Ab`: don't use 12ms, _AB, B2 or the xxsql MyDB. Dr Lamport's Thing Labs"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = [(t.normal, t.tags) for r in tagger.tagged_sentences(df).orderBy("sentence").collect() for t in r.tokens]
    tags = dict(found)
    assert tags["running"] == ["Verb", "Noun"] and tags["12ms"] == ["Value", "Unit"] and tags["dont"] == ["Noun"]
    assert tags["_ab"] == tags["b2"] == ["Acronym", "TechnicalTerm", "ProperNoun", "Noun"] and tags["ab"] == ["TechnicalTerm", "ProperNoun", "Noun"]
    assert tags["xxsql"] == ["TechnicalTerm", "Noun"] and tags["lamports"] == ["TechnicalTerm", "Noun", "ProperNoun", "Person"] and tags["thing"] == ["Verb", "ProperNoun", "Noun", "Organization"]
    # No array is put together for a token by its form alone: each case is a constant.
    form = F.struct(F.col("text").alias("token"), F.lower("text").alias("normal"), F.lit(False).alias("ticked"), F.col("text").rlike("^[A-Z]").alias("capital"), F.lit(False).alias("upper"))
    assert "concat" not in df.select(tagger._first_tags(form))._jdf.queryExecution().optimizedPlan().toString()


def test_tfidf_scores_keep_no_table_of_all_terms(spark, monkeypatch):
    kept = []
    durable = retrieval.durable
    monkeypatch.setattr(retrieval, "durable", lambda df: kept.append(set(df.columns)) or durable(df))
    # Rows of one id are one document, also one without a term of the query.
    rows = [(1, "stone river stone"), (2, "lake"), (3, "river wall"), (3, "wall lake tree"), (4, None), (None, "stone"), (None, "the wall")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.cosine for r in retrieval.tfidf_scores(df, "id", F.col("text"), "stone the stone bridge").collect()}
    idf = {w: math.log((7 + 1 + 1) / (n + 1)) + 1 for w, n in {"stone": 3, "river": 2, "wall": 3, "bridge": 1}.items()}
    norm = lambda *x: math.sqrt(sum(v * v for v in x))
    asked = norm(2 * idf["stone"], idf["bridge"])
    want = {1: 2 * idf["stone"] * 2 * idf["stone"] / (norm(2 * idf["stone"], idf["river"]) * asked), None: idf["stone"] * 2 * idf["stone"] / (norm(idf["stone"], idf["wall"]) * asked)}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert kept and not any({"id", "term"} <= c for c in kept)


def test_container_blocks_read_the_headers_once(spark, monkeypatch):
    kept = []
    durable = container_queries.durable
    monkeypatch.setattr(container_queries, "durable", lambda df: kept.append(set(df.columns)) or durable(df))
    found = container_queries.container_blocks(spark, "/root/testdata/sf0.001")
    assert any("body" in c for c in kept)
    # The header's pattern stood in the plan for each style.
    assert "regexp_extract" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_documents_of_a_bucket_share_a_state(spark, tmp_path):
    def convert(text):
        if "bad" in text:
            raise ValueError("no")
        return f"# {text}"

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(200).selectExpr("id AS doc_id", "'document' AS kind", "if(id % 4 = 0, 'bad', concat('t', id)) AS text", "0 AS ord").coalesce(1).write.parquet(source)
    events = spark.readStream.schema("doc_id long, kind string, text string, ord int").parquet(source)
    q = queue.run_queue(events, out, str(tmp_path / "cp"), convert, max_attempts=3, backoff_ms=50, interval="0 seconds", buckets=2)
    end, got = time.monotonic() + 90, {}
    while time.monotonic() < end and sum(r[0] == "error" for r in got.values()) < 50:
        assert q.exception() is None
        time.sleep(0.5)
        if (tmp_path / "out" / "batch=0" / "_SUCCESS").exists():
            got = {r.doc_id: tuple(r)[1:] for r in queue.queue_table(spark, out).collect()}
    states = {p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]}
    q.stop()
    assert got == {i: ("success", 1, None, f"# t{i}") if i % 4 else ("error", 3, "no", None) for i in range(200)}
    steps = [(r.status, r.attempts) for r in queue.queue_log(spark, out).where("doc_id = 4").orderBy("batch", "step").collect()]
    assert steps == [("pending", 0), ("pending", 1), ("pending", 2), ("error", 3)]
    assert max(states) == 2


def test_toxicity_is_fitted_on_every_labelled_row(spark, monkeypatch):
    seen = []
    learned = toxicity.learn_lexicon
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda words, toxic, clean: seen.append((toxic, clean)) or learned(words, toxic, clean))
    docs = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 10 = 0, 'a vile word', 'a word') AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 10 = 0 AS int) AS toxic")
    found = toxicity.fit(docs, labels)
    kept = labels.where("crc32(cast(doc_id AS string)) % 5 <> 0")
    assert seen == [(kept.where("toxic = 1").count(), kept.where("toxic = 0").count())] and sum(seen[0]) > 20_000
    assert found.terms == ["vile"] and (found.score(["a vile word", "a word"]) >= 0.5).tolist() == [True, False]


def test_sums_of_tasks_give_the_weights_of_all_rows():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(4000, 3))
    y = (x @ np.array([1.0, -2.0, 0.5]) + draw.logistic(size=4000) > 1).astype(float)
    whole = toxicity.fit_logistic(lambda w: toxicity.logistic_sums(x, y, w), 3)
    parts = toxicity.fit_logistic(lambda w: sum(toxicity.logistic_sums(x[i::7], y[i::7], w) for i in range(7)), 3)
    assert np.allclose(whole, parts, atol=1e-9)
    slope = toxicity.logistic_sums(x, y, whole)[1:5] + np.array([1e-6, 1, 1, 1]) * whole
    assert np.abs(slope).max() < 1e-6


def test_words_known_by_hash_are_what_they_were(monkeypatch):
    monkeypatch.setattr(toxicity, "_MOST_KNOWN", 3)
    a = toxicity.Automaton(["grumblefoot", "snarkwort", "mud"], ["stemm"])
    words = ["grumblefoot", "grumblefot", "snarkwort", "snrkwrt", "mud", "mad", "stemming", "other", "mud", "grumblefoot"]
    want = [toxicity.EXACT, toxicity.FUZZY, toxicity.EXACT, toxicity.FUZZY, toxicity.EXACT, 0, toxicity.STEM, 0, toxicity.EXACT, toxicity.EXACT]
    for n in (1, 4, 10, 10, 10):
        points, _, start, end, _ = toxicity._words([" ".join(words[:n])])
        assert a.match(points, start, end).tolist() == want[:n]


def test_native_stages_run_no_python(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"mail jo{i}@example.org and more words", "ab"[i % 2]) for i in range(20)], "doc_id long, text string, source string").persist()
    docs.count()

    def refused(*args, **kwargs):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr(type(docs), "mapInArrow", refused)
    monkeypatch.setattr(type(docs), "mapInPandas", refused)
    assert corpus_pipeline.redact(spark, docs, "").where("text LIKE 'mail [EMAIL]%'").count() == 20
    assert corpus_pipeline.mix_sources(spark, docs, "").count() > 0
