"""Near-duplicate embeddings by an inverted multi-index.

Vectors with equal labels link when their cosine is at least ``threshold``. Codebooks of the two
halves of the unit vectors are fitted on a bounded sample; their product is a grid of cells, and
every vector is indexed in the cell of its nearest centroids. A vector then visits cells by a
multi-sequence traversal: both halves' centroids are sorted by how far the vector is from the
border to their region, and the frontier of the two sequences advances through pairs of them,
nearest first, until the wanted recall. At ``target_recall`` 1 the radius is the largest distance
of two linked unit vectors, beyond which no cell can hold a partner. Below 1 it is measured: a drawn
set of vectors meets all rows of its labels by brute force, each of its links tells the radius at which one
of the two vectors visits the other, and the smallest radius is taken that reaches the wanted share.
Where these vectors have no link, the radius is the geometric one. Every vector of a visited cell is
verified by its cosine in double precision.

Equal vectors are one class from the start. Visitors and members of a cell are packed in blocks
by a range partitioning on cell and key, which cuts through crowded cells, and blocks meet in
matrix products. A product gives the links of each visitor, the links of each member that does not
visit the visitor in its turn (so every link counts once at both ends), and a spanning forest of
the links. A crowded cell costs arithmetic but never rows for its pairs. Distances to borders
are summed vector by vector, so that both ends of a link decide alike.

Nulls: vectors that are null, zero, or hold null or non-finite components, null labels and null
ids link with nothing (a null id also has no component). Halves are split at half the length;
only vectors of equal length are compared. Repeated ids are vectors of their own. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.components import connected_components, forest
from marlstone.llm.topk import vectors
from marlstone.session import bound_batches, durable


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which rows are not zero."""
    top = np.abs(m).max(1)
    ok = top > 0
    scaled = m / np.where(ok, top, 1)[:, None]
    return scaled / np.maximum(np.sqrt((scaled * scaled).sum(1)), 1e-300)[:, None], ok


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[: min(k, len(distinct))]].copy()
    for _ in range(rounds):
        near = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
        own = near.argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class MultiIndex:
    """The two codebooks and the squared radius that the traversal covers."""

    def __init__(self, first: np.ndarray, second: np.ndarray, radius2: float) -> None:
        self.books, self.radius2 = (first, second), radius2
        self.links, self.reached = 0, 0  # of the measured vectors: by brute force, and those that the traversal meets
        self.gaps = []
        for c in self.books:
            d = np.sqrt(np.maximum(0, (c * c).sum(1)[:, None] - 2 * c @ c.T + (c * c).sum(1)))
            np.fill_diagonal(d, 1.0)
            self.gaps.append(np.maximum(d, 1e-12))

    def borders(self, u: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid, and for each centroid the squared distance to the border of its region."""
        c = self.books[half]
        part = u[:, : u.shape[1] // 2] if half == 0 else u[:, u.shape[1] // 2 :]
        d = np.empty((len(part), len(c)))
        for j in range(len(c)):  # a product of matrices would round by the number of rows
            d[:, j] = ((part - c[j]) ** 2).sum(1)
        own = d.argmin(1)
        over = np.maximum(0, d - d[np.arange(len(d)), own][:, None]) / (2 * self.gaps[half][own])
        return own, over * over

    def cell(self, u: np.ndarray) -> np.ndarray:
        return self.borders(u, 0)[0] * len(self.books[1]) + self.borders(u, 1)[0]

    def traverse(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell that each vector visits."""
        (_, a), (_, b) = self.borders(u, 0), self.borders(u, 1)
        ia, ib = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
        a, b = np.take_along_axis(a, ia, 1), np.take_along_axis(b, ib, 1)
        rows, cells = [], []
        live = np.arange(len(u))
        for i in range(a.shape[1]):
            live = live[a[live, i] <= self.radius2]
            if len(live) == 0:
                break
            # The frontier at step i of the first sequence: how far the second may go.
            reach = (b[live] + a[live, i][:, None] <= self.radius2).sum(1)
            r = np.repeat(live, reach)
            j = np.arange(len(r)) - np.repeat(np.cumsum(reach) - reach, reach)
            rows.append(r)
            cells.append(ia[r, i] * len(self.books[1]) + ib[r, j])
        return np.concatenate(rows), np.concatenate(cells)


def fit_index(sample: np.ndarray, per_label: float, threshold: float, per_cell: int = 48) -> MultiIndex:
    """Codebooks of a size that puts about ``per_cell`` vectors of a label in a cell; the radius is the geometric one."""
    k = int(np.clip(np.ceil(np.sqrt(per_label / per_cell)), 2, max(2, len(sample) // 16)))
    half = sample.shape[1] // 2
    return MultiIndex(kmeans(sample[:, :half], k), kmeans(sample[:, half:], k), 2 - 2 * threshold + 1e-9)


_BINS = 1 << 14


def _gaps(shared, queries, threshold: float):
    """(dim, bin, n): links between the measured vectors and a task's rows, by the radius that finds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        asked: dict[int, dict] = {}
        for d, index in shared.value.items():
            asked[d] = {}
            counts[d] = np.zeros(_BINS + 1, np.int64)
            for label, (keys, u) in queries.value.get(d, {}).items():
                asked[d][label] = (keys, u, index.borders(u, 0), index.borders(u, 1))
        for b in batches:
            key, label = b.column(0).to_numpy(), b.column(1).to_numpy()
            for rows, m in vectors(b.column(2)):
                d = m.shape[1]
                if d not in asked:
                    continue
                index = shared.value[d]
                u, ok = unit(m)
                rows, u = rows[ok], u[ok]
                for of in np.unique(label[rows]).tolist():
                    if of not in asked[d]:
                        continue
                    here = np.flatnonzero(label[rows] == of)
                    keys, q, (own_a, a), (own_b, b_) = asked[d][of]
                    linked = q @ u[here].T >= threshold
                    linked &= keys[:, None] != key[rows[here]][None, :]
                    r, c = np.nonzero(linked)
                    if not len(r):
                        continue
                    met, back = np.unique(c, return_inverse=True)
                    (m_own_a, m_a), (m_own_b, m_b) = index.borders(u[here[met]], 0), index.borders(u[here[met]], 1)
                    there = a[r, m_own_a[back]] + b_[r, m_own_b[back]]
                    home = m_a[back, own_a[r]] + m_b[back, own_b[r]]
                    share = np.minimum(there, home) / index.radius2
                    counts[d] += np.bincount(np.clip(np.ceil(share * _BINS), 0, _BINS).astype(np.int64), minlength=_BINS + 1)
        for d, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), d, np.int32)), pa.array(some), pa.array(n[some])], ["dim", "bin", "n"])

    return run


def _measured(classes: DataFrame, shared, indexes: dict[int, MultiIndex], threshold: float, target_recall: float, recall_queries: int) -> None:
    """Set each index's radius by the links of drawn vectors to all rows."""
    spark = classes.sparkSession
    drawn = classes.orderBy(F.xxhash64("key", F.lit("recall"))).limit(recall_queries).select("key", "label", "embedding").collect()
    held: dict[int, dict[int, tuple]] = {}
    for r in drawn:
        held.setdefault(len(r["embedding"]), {}).setdefault(r["label"], []).append((r["key"], r["embedding"]))
    asked = {}
    for d, by in held.items():
        asked[d] = {label: (np.array([k for k, _ in rows], np.int64), unit(np.array([e for _, e in rows]))[0]) for label, rows in by.items()}
    queries = spark.sparkContext.broadcast(asked)
    found = classes.select("key", "label", "embedding").mapInArrow(_gaps(shared, queries, threshold), "dim int, bin long, n long").groupBy("dim", "bin").agg(F.sum("n").alias("n")).collect()
    queries.destroy()
    for d, index in indexes.items():
        n = np.zeros(_BINS + 1, np.int64)
        for r in found:
            if r["dim"] == d:
                n[r["bin"]] += r["n"]
        met = np.cumsum(n)
        index.links = index.reached = int(met[-1])
        if index.links:
            # The first bin whose links and those before reach the share: the order statistic, rounded up.
            at = int(np.searchsorted(met, int(np.ceil(target_recall * index.links))))
            index.reached = int(met[at])
            if at < _BINS:
                index.radius2 *= at / _BINS


_ENTRY = "label long, dim int, cell long, key long, mult long, cells binary"
_BLOCK = "label long, dim int, cell long, keys binary, mults binary, cells binary"


def _entries(shared, visit: bool):
    """Rows for the cells that a vector visits, or for the cell that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, label, mult = (b.column(i).to_numpy() for i in (0, 1, 2))
            for rows, m in vectors(b.column(3)):
                d = m.shape[1]
                index = shared.value.get(d)
                u, ok = unit(m)
                rows, u = rows[ok], u[ok]
                step = 4096 if index is None else max(64, (1 << 20) // len(index.books[0]))
                for at in range(0, len(rows), step):
                    part, r = u[at : at + step], rows[at : at + step]
                    if index is None:
                        who, cell = np.arange(len(part)), np.zeros(len(part), np.int64)
                    elif visit:
                        who, cell = index.traverse(part)
                    else:
                        who, cell = np.arange(len(part)), index.cell(part)
                    raw = part.tobytes()
                    for lo in range(0, len(who), 4096):
                        w = who[lo : lo + 4096]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(label[r[w]]), pa.array(np.full(len(w), d, np.int32)), pa.array(cell[lo : lo + 4096].astype(np.int64)), pa.array(key[r[w]]), pa.array(mult[r[w]]), pa.array([raw[8 * d * i : 8 * d * (i + 1)] for i in w.tolist()], pa.binary())],
                            ["label", "dim", "cell", "key", "mult", "cells"],
                        )

    return run


def _blocks(most: int):
    """Packs rows sorted by cell into blocks of one cell and at most ``most`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, mults, cells = None, [], [], []
        out: list[tuple] = []

        def close() -> None:
            if keys:
                out.append((*now, np.array(keys, np.int64).tobytes(), np.array(mults, np.int64).tobytes(), b"".join(cells)))

        for b in batches:
            for *place, key, mult, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if place != now or len(keys) >= most:
                    close()
                    now, keys, mults, cells = place, [], [], []
                keys.append(key)
                mults.append(mult)
                cells.append(raw)
            if len(out) >= 64:
                yield _as_batch(out)
                out = []
        close()
        yield _as_batch(out)

    return run


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["label", "dim", "cell", "keys", "mults", "cells"])


def _verify(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, vk, vm, vc, mk, mm, mc in zip(*(c.to_pylist() for c in b.columns), strict=True):
                who, members, weight, mult = (np.frombuffer(x, np.int64) for x in (vk, mk, vm, mm))
                u, v = np.frombuffer(vc).reshape(-1, dim), np.frombuffer(mc).reshape(-1, dim)
                linked = u @ v.T >= threshold
                linked &= who[:, None] != members[None, :]
                r, c = np.nonzero(linked)
                if len(r) == 0:
                    continue
                index = shared.value.get(dim)
                counts = [(who, linked @ mult)]
                if index is not None:
                    # Members that do not visit the visitor's cell hear of the link here.
                    met, back = np.unique(c, return_inverse=True)
                    seen, at = np.unique(r, return_inverse=True)
                    reach = sum(index.borders(v[met], h)[1][back, index.borders(u[seen], h)[0][at]] for h in (0, 1))
                    one_way = reach > index.radius2
                    counts.append((members, np.bincount(c[one_way], weight[r[one_way]], len(members)).astype(np.int64)))
                for ends, n in counts:
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(ends[some]), pa.nulls(len(some), pa.int64()), pa.array(n[some])], ["a", "b", "n"])
                x, y = forest(r, c, who, members)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.zeros(len(x), np.int64))], ["a", "b", "n"])

    return run


def near_duplicates(vecs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, target_recall: float = 0.9999, sample_rows: int = 20_000, recall_queries: int = 1000, block_rows: int = 512) -> DataFrame:
    """vec_id, n_links, component_id, kept and sample_recall of every vector.

    sample_rows: the most vectors that the codebooks are fitted on (16 for each centroid at least);
    every vector is indexed. target_recall: the share of the links between ``recall_queries`` drawn
    vectors and all rows, counted by brute force, that the traversal has to meet; at 1 it goes as far
    as any link can be. sample_recall: the share that it meets (1 where these vectors have no link, as
    the traversal then goes that far too).
    """
    spark = vecs.sparkSession
    bound_batches(spark)
    base = vecs.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("long").alias("label"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    usable = usable & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    keyed = base.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "embedding")))
    members = keyed.where("key IS NOT NULL")
    classes = durable(members.groupBy("key").agg(F.first("label").alias("label"), F.count("*").alias("mult"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("first_id")))
    shape = classes.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    sample = classes.orderBy(F.xxhash64("key")).limit(sample_rows).select("label", "embedding").collect()
    indexes = {}
    for d in {len(r["embedding"]) for r in sample}:
        of = [r for r in sample if len(r["embedding"]) == d]
        if d >= 2:
            u, ok = unit(np.array([r["embedding"] for r in of]))
            indexes[d] = fit_index(u[ok], shape["n"] / max(1, shape["labels"]), threshold)
    if target_recall < 1:
        fitted = spark.sparkContext.broadcast(indexes)
        _measured(classes, fitted, indexes, threshold, target_recall, recall_queries)
        fitted.destroy()
    shared = spark.sparkContext.broadcast(indexes)  # at most a sixteenth of the sample as centroids, twice
    links = sum(i.links for i in indexes.values())
    recall = F.lit(sum(i.reached for i in indexes.values()) / links if links else 1.0)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = classes.select("key", "label", "mult", "embedding")
    packed = {}
    for visit in (True, False):
        entries = source.mapInArrow(_entries(shared, visit), _ENTRY)
        packed[visit] = entries.repartitionByRange(parts, "label", "dim", "cell", "key").sortWithinPartitions("label", "dim", "cell", "key").mapInArrow(_blocks(block_rows), _BLOCK)
    place = ["label", "dim", "cell"]
    # Crowded cells: their visitors are salted, their members sent to each salt.
    blocks = durable(packed[False])
    crowds = blocks.groupBy(*place).agg(F.ceil(F.count("*") / 4).alias("salts"))
    held = blocks.join(crowds, place).select(*place, F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("keys").alias("m_keys"), "mults", F.col("cells").alias("m_cells"))
    coming = packed[True].join(crowds, place).select(*place, F.pmod(F.xxhash64("keys"), F.col("salts")).alias("salt"), F.col("keys").alias("v_keys"), F.col("mults").alias("v_mults"), F.col("cells").alias("v_cells"))
    met = coming.join(held, [*place, "salt"]).select("dim", "v_keys", "v_mults", "v_cells", "m_keys", "mults", "m_cells")
    found = durable(met.mapInArrow(_verify(shared, threshold), "a long, b long, n long"))

    counts = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    roots = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    named = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").join(counts, "key", "left")
    named = named.select("key", "first_id", F.coalesce("root", "key").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_key = named.join(smallest, "root").select("key", "n_links", "component_id")
    inside = members.select("vec_id", "key").join(by_key, "key").select("vec_id", "n_links", "component_id")
    outside = keyed.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionAll(outside).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), recall.alias("sample_recall"))
