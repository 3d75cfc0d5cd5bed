"""Exact top-k search by tiled matrix products and tree merging of per-query lists.

Candidates are packed as they are read into blocks of about ``block_bytes``, queries into tiles.
Blocks are dealt over shards; every tile is sent to every shard, and a task multiplies the tiles
that reach it with its blocks. Of each product only every query's k best stay (partial
selection), and a task merges them with those of its tile's earlier products. Lists of a query
are then merged ``fan`` shards at a time, level by level.

Components are floor(scale * x). Products run in float32 or float64 where the largest component
proves them exact, else in 64-bit integers, and beyond those in Python's.

Nulls: vectors that are null, or hold null or non-finite components, take no part, nor do rows
without an id. Only vectors of equal length are compared. A query is not its own candidate: rows
with its id are left out. Repeated ids are candidates of their own, and equal rows of a query are
one query; rows of one id with different vectors share a list of the best of all. Ties go to the
smaller id.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import bound_batches, durable

_BATCH_TILES = 32


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the finite vectors of a list column, by length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
    for d in np.unique(sizes[ok]).tolist():
        rows = np.flatnonzero(ok & (sizes == d))
        m = flat[offsets[rows][:, None] + np.arange(d)]
        good = np.isfinite(m).all(1)
        if good.any():
            yield rows[good], m[good]


def _pack(scale: float, block_bytes: int, tile: bool):
    names = ["number", "dim", "ids", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        n = 0

        def out(d: int) -> pa.RecordBatch:
            nonlocal n
            parts = held.pop(d)
            ids = np.concatenate([p[0] for p in parts])
            cells = np.concatenate([p[1] for p in parts])
            n += 1
            number = int(ids[0] * 2654435761 % 2147483647) if tile else n
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([d], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary())], names)

        for b in batches:
            ids = b.column(0).to_numpy()
            for rows, m in vectors(b.column(1)):
                d = m.shape[1]
                most = max(64, block_bytes // (8 * d))
                cells = np.floor(m * scale)
                for at in range(0, len(rows), most):
                    held.setdefault(d, []).append((ids[rows[at : at + most]].astype(np.int64), cells[at : at + most]))
                    if sum(len(p[0]) for p in held[d]) >= most:
                        yield out(d)
        for d in list(held):
            yield out(d)

    return run


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if q.size == 0 or c.size == 0:
        return np.zeros((len(q), len(c)), np.int64)
    bound = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
    if bound < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    if bound < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _kept(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, candidate, score) entries of each query."""
    query, cand, score = (np.concatenate(x) for x in zip(*lists, strict=True))
    order = np.lexsort((cand, -score, query))
    query, cand, score = query[order], cand[order], score[order]
    starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    return query[place < k], cand[place < k], score[place < k]


def _partial(query: np.ndarray, q: np.ndarray, cand: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's k best in one product; ``cand`` is sorted."""
    s = _product(q, c)
    own = query[:, None] == cand[None, :]
    keep = min(len(cand), k + int(own.sum(1).max(initial=0)))
    take = ~own
    if keep < len(cand):
        # Scores above the k-th best, and of those equal to it the first.
        bar = np.partition(s, len(cand) - keep, axis=1)[:, len(cand) - keep][:, None]
        above, equal = s > bar, s == bar
        take &= above | (equal & (np.cumsum(equal, 1) <= (keep - above.sum(1))[:, None]))
    r, col = np.nonzero(take)
    return query[r], cand[col], s[r, col]


def _best(k: int):
    """Lists from rows (shard, batch, dim, side, ids, cells): a batch's tiles come first and are held, the blocks of the shard pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for query, _, lists in held:
                if lists:
                    parts = _kept(lists, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts[0]), now[0], np.int64)), *(pa.array(x) for x in parts)], ["shard", "query_id", "vec_id", "score"])

        for b in batches:
            for shard, batch, dim, side, ids, cells in zip(*(b.column(j).to_pylist() for j in range(6)), strict=True):
                if (shard, batch, dim) != now:
                    yield from out()
                    now, held = (shard, batch, dim), []
                who, m = np.frombuffer(ids, np.int64), np.frombuffer(cells).reshape(-1, dim)
                if side == 0:
                    held.append((who, m, []))
                    continue
                order = np.argsort(who, kind="stable")  # ties then go by position
                who, m = who[order], m[order]
                for query, q, lists in held:
                    lists.append(_partial(query, q, who, m, k))
                    if sum(len(x[0]) for x in lists) > 4 * k * len(query):
                        lists[:] = [_kept(lists, k)]
        yield from out()

    return run


def _merged(lists: DataFrame, group: Column, k: int) -> DataFrame:
    """The k best of each query and group of shards."""
    one = F.struct((-F.col("score")).alias("minus"), "vec_id", "score")
    return lists.withColumn("shard", group).groupBy("query_id", "shard").agg(F.slice(F.array_sort(F.collect_list(one)), 1, k).alias("best")).select("query_id", "shard", F.explode("best").alias("b")).select("query_id", "shard", "b.vec_id", "b.score")


def top_k(candidates: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0, block_bytes: int = 4 << 20, fan: int = 8) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best candidates."""
    spark = candidates.sparkSession
    bound_batches(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = "number long, dim int, ids binary, cells binary"

    def rows(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))

    blocks = rows(candidates).mapInArrow(_pack(scale, block_bytes, False), packed).withColumn("shard", F.pmod(F.xxhash64("number", "ids"), F.lit(shards)))
    tiles = durable(rows(queries).distinct().mapInArrow(_pack(scale, block_bytes // 8, True), packed))
    # A task holds the tiles of one batch, about _BATCH_TILES, and each block is sent to every batch.
    n_batches = max(1, -(-tiles.count() // _BATCH_TILES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    dealt = tiles.select(every(shards).alias("shard"), F.pmod(F.xxhash64("number", "ids"), F.lit(n_batches)).alias("batch"), "dim", F.lit(0).alias("side"), "ids", "cells")
    dealt = dealt.unionAll(blocks.select("shard", every(n_batches).alias("batch"), "dim", F.lit(1).alias("side"), "ids", "cells"))
    met = dealt.repartition(shards, "shard", "batch", "dim").sortWithinPartitions("shard", "batch", "dim", "side")
    lists = met.mapInArrow(_best(k), "shard long, query_id long, vec_id long, score long")
    groups = shards
    while groups > 1:
        groups = -(-groups // fan)
        lists = _merged(lists, F.floor(F.col("shard") / fan).cast("long"), k)
    one = F.struct((-F.col("score")).alias("minus"), "vec_id", "score")
    final = lists.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(one)), 1, k).alias("best"))
    return final.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score")
