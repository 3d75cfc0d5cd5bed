"""Links of the multi-index at several targets: counted at both ends, and as many as promised."""

import numpy as np
import pytest

from marlstone.llm import embedding_dedup

COSINE = 0.98


def planted(seed, n=1500, copies=700, labels=1):
    """Random unit vectors and noisy copies about the threshold."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x[rng.integers(0, n, copies)] + rng.normal(size=(copies, 16)) * rng.uniform(0.01, 0.06, copies)[:, None]
    both = np.concatenate([x, y])[rng.permutation(n + copies)]
    return both, rng.integers(0, labels, n + copies)


def links(x, label):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = (u @ u.T >= COSINE) & (label[:, None] == label[None, :])
    np.fill_diagonal(s, False)
    return s


def frame(spark, x, label):
    return spark.createDataFrame([(i, v.tolist(), int(z)) for i, (v, z) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label long")


@pytest.mark.parametrize("target", [0.9, 0.99, 0.9999, 1.0])
def test_links_count_at_both_ends(spark, target):
    x, label = planted(1)
    want = links(x, label)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(frame(spark, x, label), target_recall=target, recall_queries=400, block_rows=32).collect()}
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n <= want.sum(1)).all()
    assert n.sum() % 2 == 0  # every link found has two ends
    assert n.sum() >= (min(target, 0.995) - 0.02) * want.sum()  # the rows drawn tell of all rows
    assert got[0]["sample_recall"] >= target and want.sum() > 1000
    if target == 1.0:
        assert (n == want.sum(1)).all()
    # Rows with links are joined, and with rows that link with them only.
    for i in np.flatnonzero(n).tolist():
        assert any(got[j]["component_id"] == got[i]["component_id"] for j in np.flatnonzero(want[i]).tolist())
    assert all(got[i]["component_id"] == i for i in np.flatnonzero(want.sum(1) == 0).tolist())


def test_both_ends_agree_where_few_links_are_found(spark):
    """A radius far too small: what is found is found for both ends, whatever cells they lie in."""
    x, label = planted(2, labels=2)
    want = links(x, label)
    df = frame(spark, x, label)
    old = embedding_dedup._measured

    def small(classes, shared, indexes, *rest):
        old(classes, shared, indexes, *rest)
        for index in indexes.values():
            index.radius2 /= 50

    embedding_dedup._measured = small
    try:
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, target_recall=0.9, block_rows=32).collect()}
    finally:
        embedding_dedup._measured = old
    total = sum(got.values())
    assert total % 2 == 0 and 0 < total < want.sum()
    # A link of two rows that have no other: both say one, or both none.
    pairs = [(i, int(np.flatnonzero(want[i])[0])) for i in np.flatnonzero(want.sum(1) == 1).tolist()]
    alone = [(i, j) for i, j in pairs if want[j].sum() == 1]
    assert len(alone) > 50 and all(got[i] == got[j] for i, j in alone)


def test_without_links_nothing_is_missed(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 32))
    got = embedding_dedup.near_duplicates(frame(spark, x, np.zeros(300, int))).collect()
    assert all(r["n_links"] == 0 and r["sample_recall"] == 1.0 for r in got)


def test_measure_takes_the_order_statistic_up():
    """Of two links both are reached, whatever share below 1 is asked for."""
    index = embedding_dedup.MultiIndex(np.eye(2), np.eye(2), 0.04)
    u = np.array([[1, 0, 0, 1.0], [0.999, 0.0447, 0, 1]])
    alone, together = index.borders(u[1:], 0), index.borders(u, 0)
    assert (alone[1][0] == together[1][1]).all()  # a vector's distances do not depend on its neighbours
