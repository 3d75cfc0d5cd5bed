"""Quality classifier: random Fourier features on document statistics, ridge, isotonic calibration.

Each text becomes a few statistics of its words, characters and lines. Random Fourier features
of the standardised statistics approximate a Gaussian kernel. Partitions sum the normal
equations of the ridge regression; only those sums reach the driver. The scores of training rows
that the ridge did not see are calibrated by isotonic regression (pooled adjacent violators).

Bounds: ``max_rows`` labelled rows are fitted on. Every text is scored whole. Nulls: a null text
scores as an empty one; null labels are not learned from; a null id keeps its row and is not held
out. With labels of one kind only, every score is that kind; without labels, 0.5. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textkernel as tk
from marlstone.llm.labelled import fold, training_rows
from marlstone.session import bound_batches, durable

STATISTICS = ("chars", "words", "word_length", "long_words", "upper", "digits", "marks", "bars", "outside_ascii", "odd_ends", "doubled_marks", "shouted", "distinct", "top_share", "repeated_pairs", "lines", "repeated_lines", "line_length")

_CLASS = np.zeros(256, np.uint8)  # 0: space, 1: lower, 2: upper, 3: digit, 4: mark, 5: outside ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 5
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4


def _repeated(h: np.ndarray) -> tuple[float, float]:
    """Share of entries that are not the first of their value, and share of the commonest value."""
    if len(h) == 0:
        return 0.0, 0.0
    a = np.sort(h)
    new = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    return 1 - len(new) / len(a), np.diff(np.append(new, len(a))).max() / len(a)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    out = np.zeros((len(column), len(STATISTICS)))
    for at, to, raw, rows in tk.chunks(column):
        n = to - at
        h, row, start, end = tk.words(raw, rows)
        kind = _CLASS[raw]
        sums = [np.concatenate(([0], np.cumsum(kind == k))) for k in range(6)]
        sums.append(np.concatenate(([0], np.cumsum(raw == 0x7C))))
        per = [(s[rows[1:]] - s[rows[:-1]]).astype(float) for s in sums]
        size = np.diff(rows).astype(float)
        visible = np.maximum(1, size - per[0])
        words = np.bincount(row, minlength=n).astype(float)
        some = np.maximum(1, words)
        length = (end - start).astype(float)
        x = out[at:to]
        x[:, 0], x[:, 1] = np.log1p(size), np.log1p(words)
        x[:, 2] = np.bincount(row, length, n) / some
        x[:, 3] = np.bincount(row[length > 24], minlength=n) / some
        for j, k in ((4, 2), (5, 3), (6, 4), (7, 6), (8, 5)):
            x[:, j] = per[k] / visible
        if len(start):
            last = raw[end - 1]
            marks = kind[end - 1] == 4
            usual = np.isin(last, np.frombuffer(b".,;:?\"')", np.uint8))
            x[:, 9] = np.bincount(row[marks & ~usual], minlength=n) / some
            before = raw[np.maximum(start, end - 2)]
            x[:, 10] = np.bincount(row[marks & (before == last) & (length > 1)], minlength=n) / some
            upper = sums[2][end] - sums[2][start]
            x[:, 11] = np.bincount(row[(upper > 1) & (upper >= 0.5 * length)], minlength=n) / some
        bounds = tk.row_slices(row, n)
        breaks = np.flatnonzero(raw == 0x0A)
        # A line starts with its row or after a break; its end is the next start.
        starts = np.unique(np.concatenate([rows[:-1][size > 0], breaks + 1]))
        starts = starts[starts < len(raw)]
        line_row = np.searchsorted(rows, starts, "right") - 1
        line_hash = tk.span_hashes(raw, starts, np.append(starts[1:], len(raw))) if len(starts) else np.zeros(0, np.uint64)
        line_bounds = tk.row_slices(line_row, n)
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) > 1 else h[:0]
        for r in range(n):
            s, e = bounds[r], bounds[r + 1]
            share, top = _repeated(h[s:e])
            x[r, 12], x[r, 13] = 1 - share, top
            x[r, 14] = _repeated(pairs[s : max(s, e - 1)])[0]
            lines = line_hash[line_bounds[r] : line_bounds[r + 1]]
            x[r, 15], x[r, 16] = np.log1p(len(lines)), _repeated(lines)[0]
            x[r, 17] = np.log1p(size[r] / max(1, len(lines)))
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function nearest to y, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    score, y = score[order], y[order].astype(float)
    value, weight, last = [], [], []
    for s, v in zip(score, y, strict=True):
        value.append(v)
        weight.append(1.0)
        last.append(s)
        while len(value) > 1 and (value[-2] >= value[-1] or last[-2] == last[-1]):
            w = weight[-2] + weight[-1]
            value[-2] = (value[-2] * weight[-2] + value[-1] * weight[-1]) / w
            weight[-2], last[-2] = w, last[-1]
            del value[-1], weight[-1], last[-1]
    return np.array(last), np.array(value)


class Model:
    """Standardisation, random features, ridge weights and the calibration's knots."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, seed: int, width: float) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.turn = rng.normal(0, 1 / width, (len(mean), features))
        self.shift = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.knots, self.values = np.zeros(1), np.full(1, 0.5)

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.ones(len(x)), np.cos(z @ self.turn + self.shift) * np.sqrt(2 / len(self.shift))])

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw_score(x), self.knots, self.values), 0, 1)


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = statistics(b.column(0))
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), b.column(1), b.column(2)], [*STATISTICS, "label", "calibrates"])


def fit(docs: DataFrame, labels: DataFrame, held_fold: int = 0, max_rows: int = 20_000, features: int = 256, ridge: float = 1e-3, width: float = 4.0, seed: int = 11) -> Model:
    """Fit on at most ``max_rows`` labelled rows; a quarter of them calibrates."""
    spark = docs.sparkSession
    train = training_rows(docs, labels, "quality", held_fold, max_rows)
    quarter = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4)) == 0).alias("calibrates")
    schema = ", ".join(f"{s} double" for s in STATISTICS) + ", label int, calibrates boolean"
    rows = durable(train.select("text", (F.col("label") != 0).cast("int").alias("label"), quarter).mapInArrow(_statistics_rows, schema))
    moments = rows.agg(F.count("*").alias("n"), F.avg("label").alias("share"), *(F.avg(s).alias(f"m_{s}") for s in STATISTICS), *(F.stddev_pop(s).alias(f"s_{s}") for s in STATISTICS)).first()
    if not moments["n"]:
        return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), features, seed, width)
    mean = np.array([moments[f"m_{s}"] for s in STATISTICS])
    scale = np.maximum(np.array([moments[f"s_{s}"] for s in STATISTICS]), 1e-6)
    model = Model(mean, scale, features, seed, width)
    if moments["share"] in (0.0, 1.0):
        model.values = np.full(1, moments["share"])
        return model
    shared = spark.sparkContext.broadcast(model)
    parts = 8

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, v = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for b in batches:
            z = shared.value.expand(np.column_stack([c.to_numpy() for c in b.columns[: len(STATISTICS)]]))
            a += z.T @ z
            v += z.T @ b.column(len(STATISTICS)).to_numpy().astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["a", "v"])

    learned = rows.where("NOT calibrates").drop("calibrates").repartition(parts).mapInArrow(sums, "a binary, v binary").collect()  # ``parts`` matrices
    a = sum((np.frombuffer(r["a"]).reshape(features + 1, -1) for r in learned), np.zeros((features + 1, features + 1)))
    v = sum((np.frombuffer(r["v"]) for r in learned), np.zeros(features + 1))
    model.weights = np.linalg.solve(a + ridge * max(1.0, a[0, 0]) * np.eye(features + 1), v)
    held = rows.where("calibrates").drop("calibrates").collect()  # max_rows rows at most
    if not held:
        held = rows.drop("calibrates").collect()
    x = np.array([tuple(r) for r in held], float)
    model.knots, model.values = isotonic(model.raw_score(x[:, :-1]), x[:, -1])
    return model


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every document."""
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, 0, max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.score(statistics(b.column(1))))], ["doc_id", "score"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(fold() == 0, F.lit(False))
    return base.mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
