"""Connected components of an edge table, by alternating star contraction.

Each round points every node at the smallest neighbour it knows of: first the larger neighbours
of every node (large star), then the smaller ones (small star). Rounds grow with the logarithm
of the component's size. Edges never reach the driver; only a count and a checksum do.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import durable


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of comparable ids to (node, root), root the smallest id of the component.

    Self-loops, repeated edges and edges with null ends are ignored; nodes without an edge are
    not returned. An empty input gives an empty output.
    """
    now = durable(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    )
    before = _checksum(now)
    while before[0]:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).unionAll(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        nearest = both.groupBy("u").agg(F.least(F.col("u"), F.min("w")).alias("least"))
        large = both.join(nearest, "u").where("w > u").select(F.col("w").alias("v"), F.col("least").alias("m")).distinct()
        parent = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(parent, "v").select(F.explode(F.array(F.struct("v", F.col("least").alias("m")), F.struct(F.col("m").alias("v"), F.col("least").alias("m")))).alias("e")).select("e.v", "e.m").where("v != m").distinct()
        now = durable(small)
        after = _checksum(now)
        if after == before:
            break
        before = after
    return now.select(F.col("v").alias("node"), F.col("m").alias("root"))


def forest(r: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the links left[r] - right[c] connect."""
    nodes, back = np.unique(np.concatenate([left[r], right[c]]), return_inverse=True)
    a, b = back[: len(r)], back[len(r) :]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    away = lab != np.arange(len(nodes))
    return nodes[away], nodes[lab[away]]
