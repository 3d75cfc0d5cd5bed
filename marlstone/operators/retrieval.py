"""Retrieval over concepts: keyword, lexical, tf-idf and graph-augmented scores, and rank fusion."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import graph
from marlstone.session import durable


_MOST_TERMS = 500_000  # terms with a count and two weights: some tens of megabytes


def keyword_score(query: str, title: Column, description: Column, tags: Column, body: Column) -> Column:
    """10 for the title, 5 for the description, 4 for any tag, 2 for the whole text."""
    q = query.lower()
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(q)
    anywhere = has(F.concat_ws(" ", title, description, F.array_join(tags, " "), body))
    tagged = F.exists(F.coalesce(tags, F.expr("cast(array() as array<string>)")), lambda t: F.lower(t).contains(q))
    return (10 * has(title).cast("int") + 5 * has(description).cast("int") + 4 * tagged.cast("int") + 2 * anywhere.cast("int")).cast("long")


def lexical_score(query: str, title: Column, description: Column, tags: Column, body: Column) -> Column:
    """Per query token 5, 3, 2 or 0.5 for title, tags, description or body, over 5 for each token."""
    tokens = [t for t in re.split(r"[^a-z0-9]+", query.lower()) if len(t) > 2]
    if not tokens:
        return F.lit(0.0)
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in (title, F.array_join(tags, " "), description, body)]
    total = F.lit(0.0)
    for t in tokens:
        total = total + F.when(low[0].contains(t), 5.0).when(low[1].contains(t), 3.0).when(low[2].contains(t), 2.0).when(low[3].contains(t), 0.5).otherwise(0.0)
    return total / (5.0 * len(tokens))


def keyword_search(concepts: DataFrame, query: str, k: int = 5, trust_tier: str = "all") -> DataFrame:
    """(id, score) of the k best concepts with any hit."""
    kept = concepts if trust_tier == "all" else concepts.where(F.col("trust_tier") == trust_tier)
    scored = kept.select("id", keyword_score(query, F.col("title"), F.col("description"), F.col("tags"), F.col("body")).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def by_id_or_path(concepts: DataFrame, name: str) -> DataFrame:
    """The first concept whose id or path is the name, or whose path ends in it."""
    return concepts.where((F.col("id") == name) | (F.col("path") == name) | F.col("path").endswith(name)).orderBy("id").limit(1)


def tfidf_scores(docs: DataFrame, id_col: str, text: Column, query: str) -> DataFrame:
    """(id, cosine) of documents against a query that counts as a document of the collection."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    n = docs.count() + 1
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(T.tokenize(F.col("q"))).alias("term"))
    total = asked.count()
    q = asked.groupBy("term").agg((F.count("*") / max(1, total)).alias("qtf"))
    # Rows of one id are one document; most ids stand once, and their terms are told apart in the row without a shuffle.
    several = durable(rows.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("_id")))
    n_several = several.count()
    several = F.broadcast(several) if n_several <= _MOST_TERMS else several
    same = F.col("id").eqNullSafe(F.col("_id"))
    single = rows.join(several, same, "left_anti") if n_several else rows
    shared = rows.join(several, same, "left_semi") if n_several else rows.limit(0)
    of_rows = lambda df: df.withColumn("tokens", T.tokenize(F.col("text"))).select("id", F.size("tokens").alias("total"), F.explode("tokens").alias("term"))
    # Exploded before they are chosen from, as Spark compiles no function over arrays.
    held = single.select(F.explode(F.array_distinct(T.pieces(F.col("text")))).alias("term")).where(T.is_token(F.col("term")))
    if n_several:
        held = held.unionAll(of_rows(shared).distinct().select("term"))
    counts = durable(held.groupBy("term").agg(F.count("*").alias("df")))
    # The query is one more document that holds its terms.
    idf = counts.join(F.broadcast(q), "term", "left").withColumn("idf", F.log(F.lit(n + 1) / (F.col("df") + F.when(F.col("qtf").isNull(), 0).otherwise(1) + 1)) + 1)
    # A document without any term of the query has no cosine: only the terms of the others are weighed.
    words = [r["term"] for r in q.select("term").collect()]  # of the query
    low = F.lower("text")
    hit = single.where(reduce(or_, (low.contains(w) for w in words), F.lit(False)))
    # The number of tokens divides all terms of a row alike, which a cosine does not see; rows of one id differ in it.
    tf = hit.select("id", F.explode(T.pieces(F.col("text"))).alias("term")).where(T.is_token(F.col("term"))).groupBy("id", "term").agg(F.count("*").cast("double").alias("tf"))
    if n_several:
        tf = tf.unionAll(of_rows(shared).groupBy("id", "term", "total").agg(F.count("*").alias("n")).select("id", "term", (F.col("n") / F.col("total")).alias("tf")))
    v = tf.join(F.broadcast(idf) if counts.count() <= _MOST_TERMS else idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"), (F.col("qtf") * F.col("idf")).alias("qw"))
    unseen = q.join(counts.select("term"), "term", "left_anti").select((F.col("qtf") * (F.log(F.lit(n + 1) / 2) + 1)).alias("qw"))
    seen = idf.where("qtf IS NOT NULL").select((F.col("qtf") * F.col("idf")).alias("qw"))
    norm = seen.unionAll(unseen).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    per = v.groupBy("id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return per.where("dot > 0").join(F.broadcast(norm)).select("id", (F.col("dot") / (F.col("norm") * F.col("qn"))).alias("cosine"))


def tfidf_search(concepts: DataFrame, query: str, k: int = 4, trust_tier: str = "all", entities: tuple[str, ...] = ()) -> DataFrame:
    """(id, score): cosine with the query, boosted by the title and by named entities, at most 1."""
    kept = concepts if trust_tier == "all" else concepts.where(F.col("trust_tier") == trust_tier)
    q = query.lower().strip()
    title = F.lower(F.coalesce("title", F.lit("")))
    boost = F.when(title.contains(q) | ((title != "") & F.lit(q).contains(title)), 0.35).otherwise(0.0)
    for e in entities:
        boost = boost + F.when(F.lower("body").contains(e.lower()) | F.array_contains("tags", e.lower()), 0.15).otherwise(0.0)
    cosine = tfidf_scores(kept, "id", F.concat_ws(" ", "title", "description", "body"), query)
    scored = kept.join(cosine, "id", "left").select("id", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), boost.alias("boost"))
    total = F.least(F.lit(1.0), F.col("cosine") + F.col("boost"))
    return scored.where((total > 0.08) | (F.col("boost") > 0)).select("id", total.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def graph_search(concepts: DataFrame, edges: DataFrame, query: str, k: int = 3, hops: int = 1, alpha: float = 0.5, trust_boost: float = 1.25, direction: str = "both", allowed: DataFrame | None = None) -> DataFrame:
    """(id, hop, score, path, via): seeds by lexical score and rank, then their neighbourhood."""
    ranks = graph.pagerank(concepts, edges)
    lexical = lexical_score(query, F.col("title"), F.col("description"), F.col("tags"), F.col("body"))
    pool = concepts if allowed is None else concepts.join(allowed.select("id").distinct(), "id", "left_semi")
    scored = pool.select("id", "trust_tier", lexical.alias("lexical")).where("lexical > 0.05").join(ranks, "id")
    score = (F.col("lexical") * (1 - alpha) + F.col("rank") * 5.0 * alpha) * F.when(F.col("trust_tier") == "human-reviewed", trust_boost).otherwise(1.0)
    seeds = scored.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k or 3)
    ordered = seeds.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))  # k rows
    return graph.expand(ordered, edges, hops, direction)


def within_budget(found: DataFrame, order: list[Column], tokens: Column, budget: int = 4000) -> DataFrame:
    """Rows in order with ``full``: whether the text fits the budget that is left; others take 50 tokens.

    Every row with tokens takes one at least, so after ``budget + 1`` of them nothing fits: only these meet
    in one row, whatever the table's size. Rows without tokens fit until the budget is passed. The order has no ties.
    """
    rows = found.withColumn("_o", F.struct(*order)).withColumn("_t", F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0)))
    taking = global_rank(rows.where("_t > 0"), [F.col("_o")])
    head = taking.where(F.col("rank") <= budget + 1).agg(F.array_sort(F.collect_list(F.struct("rank", "_t", "_o"))).alias("head"))
    kind = taking.schema["_o"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr(f"cast(array() as array<struct<rank: bigint, full: boolean, used: bigint, _o: {kind}>>)").alias("steps"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["_t"] <= budget
        used = acc["used"] + F.when(fits, x["_t"]).otherwise(F.lit(50).cast("long"))
        return F.struct(used.alias("used"), F.concat(acc["steps"], F.array(F.struct(x["rank"].cast("long").alias("rank"), fits.alias("full"), used.alias("used"), x["_o"].alias("_o")))).alias("steps"))

    steps = head.select(F.explode(F.aggregate("head", start, step, lambda acc: acc["steps"])).alias("s")).select("s.*")
    passed = steps.where(F.col("used") > budget).agg(F.min("_o").alias("_passed"))
    with_tokens = taking.join(F.broadcast(steps.select("rank", "full")), "rank", "left").select(*found.columns, F.coalesce("full", F.lit(False)).alias("full"))
    without = rows.where("_t = 0").join(F.broadcast(passed)).select(*found.columns, (F.col("_passed").isNull() | (F.col("_o") < F.col("_passed"))).alias("full"))
    return with_tokens.unionAll(without)


def global_rank(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their rank (from 1) in an order without ties, by ranges and not in one task.

    Ranges are numbered within, and each starts where the ranges before it end.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n"))
    # One row for each range.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_place", place).join(F.broadcast(starts), "_range").withColumn("rank", F.col("_start") + F.col("_place")).drop("_range", "_start", "_place")


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(id, score) from lists of (id, rank): the sum of 1 / (k + rank)."""
    every = lists[0].select("id", "rank")
    for one in lists[1:]:
        every = every.unionAll(one.select("id", "rank"))
    return every.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def dense_top_k(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """(vec_id, cosine) of the vectors nearest to a query."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = sum(float(x) ** 2 for x in query) ** 0.5
    return vectors.select("vec_id", (dot / (norm * size)).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(k)
