"""The token budget against a plain walk."""

import random

from pyspark.sql import functions as F

from marlstone.operators import retrieval


def test_budget_equals_a_walk(spark):
    rng = random.Random(1)
    for budget, low, n in ((300, 0, 400), (60, 1, 300), (5000, 0, 50), (0, 0, 20)):
        rows = [(i, rng.choice([low, 1, 5, 40, 90])) for i in range(n)]
        used, want = 0, {}
        for i, t in rows:
            fits = used + t <= budget
            want[i] = fits
            used += t if fits else 50 if t else 0
        df = spark.createDataFrame(rows, "id long, t long").repartition(3)
        assert {r["id"]: r["full"] for r in retrieval.within_budget(df, [F.col("id")], F.col("t"), budget).collect()} == want
    assert retrieval.within_budget(df.limit(0), [F.col("id")], F.col("t"), 10).collect() == []
