"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Words fall in 128 classes: the end of a text, the 63 most frequent words alone, and 64 shapes
(length, ending, letters outside ASCII). A shape class is divided in sixteen by a digit of the word's
hash. log P(word | context) sums three factors:

* P(class | context): a softmax whose logits add the weights of n-gram and skip features of the two
  classes before (previous, the one before that, both), hashed into buckets. It is trained by
  distributed gradient steps on the contexts' class counts.
* P(digit | class, context): a softmax of 16 whose logits add the digit's share of the class and the
  weights of word features: previous word (n-gram), word before that (skip), and both, each with
  the class, hashed into ``slots``. Every training text takes part in one of ``steps`` gradient
  steps, each divided by the expected counts; tasks sum over their texts, and the sums are added
  in Spark.
* P(word | class, digit): the word's smoothed share by exact counts of the whole training part, with
  half a count for all words never seen there.

Exact counts: one shuffle counts all training words. The most frequent, at most ``places``, become
a table that tasks hold; the counts of the others reach the texts by a join. Words are known by
64-bit hashes. Scoring works on batches of words as arrays.

The base score is a unigram model with add-a-half smoothing over the same counts.

Nulls: a null text is empty; a row with a null id trains and is not held out; repeated rows are
scored alike and counted each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textkernel as tk
from marlstone.llm.labelled import fold
from marlstone.session import bound_batches, durable

U64 = np.uint64
N_CLASSES, N_OWN, END = 128, 63, 0
_BUCKETS = 4096
_N_FEATURES = 1 + 2 * N_CLASSES + _BUCKETS
_CONTEXTS = N_CLASSES * N_CLASSES
_SHAPES = N_CLASSES - N_OWN - 1
_RUN_WORDS = 1 << 20
_PIECE = 1 << 9  # slots in a row of summed moments

_ENDING = np.full(256, 3, np.uint8)  # 0: letter, 1: digit, 2: sentence mark, 3: other mark
_ENDING[[*range(97, 123), *range(65, 91), *range(128, 256)]] = 0
_ENDING[48:58] = 1
_ENDING[[ord(c) for c in ".,;:!?"]] = 2


def shape_class(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The shape class of each word: a function of its bytes alone."""
    length = np.searchsorted(np.array([3, 6, 10]), end - start, "right")
    high = raw >= 128
    marks = np.concatenate(([0], np.cumsum(np.where(high, raw & 63, 0), dtype=np.int64)))
    n_high = np.concatenate(([0], np.cumsum(high)))
    some = n_high[end] > n_high[start]
    foreign = np.where(some, 1 + (marks[end] - marks[start]) % 3, 0)
    return (64 + (foreign * 4 + length) * 4 + _ENDING[raw[end - 1]]).astype(np.int64)


def digits(h: np.ndarray) -> np.ndarray:
    """The hexadecimal digit that divides a class."""
    return (tk.mix64(h ^ U64(0x8F1BBCDCBFA53E0B)) >> U64(60)).astype(np.int64)


class Vocabulary:
    """The words with a place of their own, their shapes and counts, and which of them are classes."""

    def __init__(self, hashes: np.ndarray, shapes: np.ndarray, counts: np.ndarray) -> None:
        order = np.lexsort((hashes, -counts))
        self.own = hashes[order[:N_OWN]]  # the most frequent first
        by_hash = np.argsort(hashes)
        self.sorted = hashes[by_hash]
        self.shapes, self.counts = shapes[by_hash], counts[by_hash]
        self.own_place = np.searchsorted(self.sorted, self.own)

    def place(self, h: np.ndarray) -> np.ndarray:
        """The place of each word, or -1."""
        at = np.searchsorted(self.sorted, h)
        inside = at < len(self.sorted)
        found = np.full(len(h), -1, np.int64)
        ok = np.flatnonzero(inside)
        hit = ok[self.sorted[at[ok]] == h[ok]]
        found[hit] = at[hit]
        return found

    def classes(self, place: np.ndarray, shape: np.ndarray) -> np.ndarray:
        own = np.full(len(self.sorted) + 1, -1, np.int64)
        own[self.own_place] = 1 + np.arange(len(self.own))
        c = own[place]  # place -1 reads the last entry, -1
        return np.where(c >= 0, c, shape)


class Tokens:
    """The words of a chunk of texts with their classes and contexts; an end follows each text."""

    def __init__(self, raw: np.ndarray, rows: np.ndarray, vocabulary: Vocabulary) -> None:
        self.h, self.row, start, end = tk.words(raw, rows)
        n = len(rows) - 1
        self.place = vocabulary.place(self.h)
        self.word_class = vocabulary.classes(self.place, shape_class(raw, start, end)) if len(start) else np.zeros(0, np.int64)
        # All tokens in order, ends included.
        size = np.bincount(self.row, minlength=n)
        self.n_words = size
        self.all_row = np.repeat(np.arange(n), size + 1)
        ends = np.cumsum(size + 1) - 1
        self.all_class = np.full(len(self.all_row), END, np.int64)
        inner = np.ones(len(self.all_row), bool)
        inner[ends] = False
        self.all_class[inner] = self.word_class
        first = np.zeros(len(self.all_row), bool)
        if n:
            first[np.concatenate(([0], ends[:-1] + 1))] = True
        one = np.concatenate(([END], self.all_class[:-1])) if n else self.all_class
        one = np.where(first, END, one)
        two = np.concatenate(([END], one[:-1])) if n else one
        two = np.where(first, END, two)
        self.context = one * N_CLASSES + two
        # The words of shape classes: the words before each, as hashes (0: none), their shapes and digits.
        self.shaped = np.flatnonzero(self.word_class >= N_CLASSES - _SHAPES)
        before = np.concatenate((np.zeros(2, U64), self.h))
        starts = np.concatenate(([0], np.cumsum(size)))[self.row[self.shaped]]
        at = self.shaped - starts
        self.one = np.where(at > 0, before[self.shaped + 1], U64(0))
        self.two = np.where(at > 1, before[self.shaped], U64(0))
        self.shape, self.digit = self.word_class[self.shaped] - (N_CLASSES - _SHAPES), digits(self.h[self.shaped])


def _summed(h: list[np.ndarray], shape: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words with their shapes and summed counts."""
    h, shape, n = np.concatenate(h), np.concatenate(shape), np.concatenate(n)
    order = np.argsort(h, kind="stable")
    h, shape, n = h[order], shape[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[new], shape[new], np.add.reduceat(n, new) if len(new) else n


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, shape, n) of all words, summed over runs of texts."""
    held: list[list[np.ndarray]] = [[], [], []]
    size = 0

    def out() -> pa.RecordBatch:
        h, shape, n = _summed(*held)
        return pa.RecordBatch.from_arrays([pa.array(tk.signed(h)), pa.array(shape.astype(np.int16)), pa.array(n)], ["h", "shape", "n"])

    for b in batches:
        for _, _, raw, rows in tk.chunks(b.column(0)):
            words, _, start, end = tk.words(raw, rows)
            if not len(words):
                continue
            h, first, n = np.unique(words, return_index=True, return_counts=True)
            for x, y in zip(held, (h, shape_class(raw, start[first], end[first]), n.astype(np.int64)), strict=True):
                x.append(y)
            size += len(h)
            if size >= _RUN_WORDS:
                kept = _summed(*held)
                held, size = [[x] for x in kept], len(kept[0])
                if size >= _RUN_WORDS // 2:
                    yield out()
                    held, size = [[], [], []], 0
    if size:
        yield out()


def _class_counts(shared):
    """(place, n): sums over a task's training texts of contexts and classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        joint = np.zeros(_CONTEXTS * N_CLASSES, np.int64)
        for b in batches:
            for _, _, raw, rows in tk.chunks(b.column(0)):
                t = Tokens(raw, rows, vocabulary)
                cells, n = np.unique(t.context * N_CLASSES + t.all_class, return_counts=True)
                joint[cells] += n
        at = np.flatnonzero(joint)
        for lo in range(0, len(at), 1 << 16):
            i = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(joint[i])], ["place", "n"])

    return run


def _other_words(shared):
    """(h, text_key, tf) of the words without a place, and a row of its own (tf 0) for each text."""
    names = ["h", "text_key", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for b in batches:
            key = b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(key), pa.array(np.zeros(len(key), np.int32))], names)
            for at, _, raw, rows in tk.chunks(b.column(0)):
                h, row, _, _ = tk.words(raw, rows)
                other = vocabulary.place(h) < 0
                h, row = h[other], row[other]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))) if len(h) else np.zeros(0, np.int64)
                tf = np.diff(np.append(new, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(h[new])), pa.array(key[at + row[new]]), pa.array(tf.astype(np.int32))], names)

    return run


def _packed_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of class counts for each context, from (place, n) of this task's contexts."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        place, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        for c in np.unique(place // N_CLASSES).tolist():
            own = place // N_CLASSES == c
            held.setdefault(c, np.zeros(N_CLASSES, np.int64))[place[own] % N_CLASSES] += n[own]
    ids = sorted(held)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([held[c].tobytes() for c in ids], pa.binary())], ["context", "counts"])


def _features(context: np.ndarray) -> np.ndarray:
    """The four active features of each context."""
    one, two = context // N_CLASSES, context % N_CLASSES
    bucket = (tk.mix64(context.astype(U64) + U64(1)) % U64(_BUCKETS)).astype(np.int64)
    return np.stack([np.zeros_like(one), 1 + one, 1 + N_CLASSES + two, 1 + 2 * N_CLASSES + bucket], 1)


def class_log_probabilities(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    z = weights[_features(context)].sum(1)
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _gradient(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((_N_FEATURES, N_CLASSES), np.float64)
        for b in batches:
            context = b.column(0).to_numpy().astype(np.int64)
            counts = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(-1, N_CLASSES)
            p = np.exp(class_log_probabilities(shared.value, context))
            d = counts - counts.sum(1, keepdims=True) * p
            f = _features(context)
            for j in range(f.shape[1]):
                np.add.at(g, f[:, j], d)
        yield pa.RecordBatch.from_arrays([pa.array([g.astype(np.float32).tobytes()], pa.binary())], ["g"])

    return run


def train_classes(contexts: DataFrame, totals: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    """Weights of the class softmax, by ``rounds`` distributed gradient steps."""
    spark = contexts.sparkSession
    w = np.zeros((_N_FEATURES, N_CLASSES), np.float32)
    w[0] = np.log((totals + 0.5) / (totals.sum() + 0.5 * N_CLASSES))
    squares = np.full(w.shape, 1e-10)
    n = max(1, int(totals.sum()))
    for _ in range(rounds if totals.sum() else 0):
        shared = spark.sparkContext.broadcast(w)
        # The contexts are at most _CONTEXTS rows of 1 KB, so four tasks do; each returns 2 MB.
        parts = contexts.coalesce(4).mapInArrow(_gradient(shared), "g binary").collect()
        g = sum(np.frombuffer(r["g"], np.float32).reshape(w.shape).astype(np.float64) for r in parts) / n - 1e-7 * w
        squares += g * g
        w = (w + rate * g / np.sqrt(squares)).astype(np.float32)
        shared.destroy()
    return w


class Digits:
    """The softmaxes of the digits of shape classes."""

    def __init__(self, leaf_counts: np.ndarray, leaf_words: np.ndarray, slots: int) -> None:
        """leaf_counts, leaf_words: training tokens and distinct words by shape and digit."""
        self.leaf = leaf_counts + 0.5 * (leaf_words + 1)
        self.bias = np.log(self.leaf / self.leaf.sum(1, keepdims=True)).astype(np.float32)
        self.weights = np.zeros((slots, 16), np.float32)

    def slots(self, shape: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
        """The slots of the three features of each word."""
        at = (shape.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
        mask = U64(len(self.weights) - 1)
        return [(tk.mix64(x + at) & mask).astype(np.int64) for x in (tk.mix64(one + U64(1)), tk.mix64(two + U64(2)), tk.mix64(one * U64(0xC2B2AE3D27D4EB4F) + two + U64(3)))]

    def log_probabilities(self, shape: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
        z = self.bias[shape]
        for at in slots:
            z += self.weights[at]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def step(self, observed: np.ndarray, expected: np.ndarray, rate: float, prior: float) -> None:
        self.weights += np.clip(rate * (observed - expected) / (expected + prior), -1, 1)


def _digit_moments(vocabulary, shared):
    """(piece, observed, expected): sums of the slots' digits over a task's texts, in pieces of slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Digits = shared.value
        size = model.weights.size
        seen, due, any_text = np.zeros(size), np.zeros(size), False
        lanes = np.arange(16)
        for b in batches:
            for _, _, raw, rows in tk.chunks(b.column(0)):
                t = Tokens(raw, rows, vocabulary.value)
                slots = model.slots(t.shape, t.one, t.two)
                p = np.exp(model.log_probabilities(t.shape, slots)).ravel()
                for at in slots:
                    seen += np.bincount(at * 16 + t.digit, minlength=size)
                    due += np.bincount((at[:, None] * 16 + lanes).ravel(), p, size)
                any_text = True
        width = min(_PIECE, len(model.weights)) * 16
        for i in range(size // width if any_text else 0):
            part = slice(i * width, (i + 1) * width)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([seen[part].astype(np.float32).tobytes()], pa.binary()), pa.array([due[part].astype(np.float32).tobytes()], pa.binary())], ["piece", "observed", "expected"])

    return run


def _added_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each piece."""
    held: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for i, piece in enumerate(b.column(0).to_pylist()):
            both = [np.frombuffer(b.column(c)[i].as_buffer(), np.float32) for c in (1, 2)]
            if piece in held:
                for x, y in zip(held[piece], both, strict=True):
                    x += y
            else:
                held[piece] = [x.astype(np.float64) for x in both]
    for piece, (x, y) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary()), pa.array([y.astype(np.float32).tobytes()], pa.binary())], ["piece", "observed", "expected"])


def train_digits(train: DataFrame, vocabulary, model: Digits, steps: int, rate: float = 0.5, prior: float = 5.0) -> None:
    """Gradient steps, each over its own share of the training texts."""
    spark = train.sparkSession
    schema = "piece int, observed binary, expected binary"
    for i in range(steps):
        shared = spark.sparkContext.broadcast(model)
        some = train.where(F.pmod(F.xxhash64("text_key", F.lit(29)), F.lit(steps)) == i).select("text")
        # One row for each piece: as many bytes as the weights have, twice.
        sums = some.mapInArrow(_digit_moments(vocabulary, shared), schema).repartition(max(1, len(model.weights) // _PIECE), "piece").mapInArrow(_added_pieces, schema).toArrow()
        observed, expected = np.zeros_like(model.weights), np.zeros_like(model.weights)
        for r in range(sums.num_rows):
            at = sums.column(0)[r].as_py() * _PIECE
            for into, c in ((observed, 1), (expected, 2)):
                x = np.frombuffer(sums.column(c)[r].as_buffer(), np.float32).reshape(-1, 16)
                into[at : at + len(x)] = x
        model.step(observed, expected, rate, prior)
        shared.destroy()


class Scorer:
    """What a task needs to score texts, apart from the counts of words without a place."""

    def __init__(self, vocabulary: Vocabulary, n_ends: int, table: np.ndarray, model: Digits) -> None:
        self.vocabulary, self.n_ends, self.table, self.digits = vocabulary, n_ends, table, model

    def factors(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of the class factor of all tokens, of the digits of words of shape classes, and of their leaves' sizes."""
        logs = self.digits.log_probabilities(t.shape, self.digits.slots(t.shape, t.one, t.two))[np.arange(len(t.shape)), t.digit]
        return self.table[t.context, t.all_class], logs / np.log(10), np.log10(self.digits.leaf[t.shape, t.digit])

    def score(self, raw: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        n = len(rows) - 1
        t = Tokens(raw, rows, self.vocabulary)
        has = t.place >= 0
        row, c = t.row[has], self.vocabulary.counts[t.place[has]]
        log_count = np.log10(c + 0.5)
        known = np.bincount(row, c > 0, n) + (self.n_ends > 0)
        base = np.bincount(row, log_count, n) + np.log10(self.n_ends + 0.5)
        in_class, in_digits, leaf = self.factors(t)
        shaped = t.word_class[has] >= N_CLASSES - _SHAPES
        model = np.bincount(t.all_row, in_class, n) + np.bincount(t.row[t.shaped], in_digits - leaf, n)
        model += np.bincount(row[shaped], log_count[shaped], n)
        return [t.n_words + 1, known.astype(np.int64), base, model]


def _scored(shared):
    names = ["doc_id", "text_key", "held_out", "n_tokens", "known", "base", "model"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [shared.value.score(raw, rows) for _, _, raw, rows in tk.chunks(b.column(0))]
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] or [np.zeros(0)] * 4
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), b.column(3), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names)

    return run


def frequent_words(words: DataFrame, places: int) -> Vocabulary:
    """The words of a count from which on there are at most ``places``; ``words`` has h, shape and c."""
    level = F.floor(4 * F.log2("c"))
    kept, lowest = 0, None
    for r in sorted(words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):  # 252 levels at most
        kept += r["n"]
        if kept > places:
            break
        lowest = r["level"]
    if lowest is None:
        return Vocabulary(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    top = words.where(level >= lowest).select("h", "shape", "c").toArrow()  # ``places`` rows at most
    h, shape, c = (x.to_numpy().astype(np.int64) for x in top.columns)
    return Vocabulary(h.view(U64), shape, c)


def fit(train: DataFrame, places: int = 1 << 16, rounds: int = 12, rate: float = 0.5, steps: int = 4, slots: int = 1 << 13) -> tuple[Scorer, DataFrame, int, int]:
    """The scorer, the words table (h, c), the training tokens and the distinct ones; ``train`` has text and text_key."""
    spark = train.sparkSession
    sc = spark.sparkContext
    counted = train.select("text").mapInArrow(_word_counts, "h long, shape short, n long")
    words = durable(counted.groupBy("h").agg(F.min("shape").alias("shape"), F.sum("n").alias("c")))
    n_ends = train.count()
    vocabulary = sc.broadcast(frequent_words(words, places))

    joint = durable(train.select("text").mapInArrow(_class_counts(vocabulary), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")))
    totals = np.zeros(N_CLASSES, np.int64)
    for r in joint.groupBy((F.col("place") % N_CLASSES).alias("cls")).agg(F.sum("n").alias("n")).collect():  # N_CLASSES rows
        totals[r["cls"]] = r["n"]
    contexts = durable(joint.repartition(6, F.floor(F.col("place") / N_CLASSES)).mapInArrow(_packed_contexts, "context int, counts binary"))
    weights = train_classes(contexts, totals, rounds, rate)

    # Tokens and words of each leaf; words that are classes of their own are taken out again.
    leaves = words.select("shape", "c", "h").mapInArrow(_leaf_sums, "leaf int, c long, n long").groupBy("leaf").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).toArrow()  # 16 rows for each shape
    counts, distinct = np.zeros(_SHAPES * 16), np.zeros(_SHAPES * 16)
    at = leaves.column(0).to_numpy()
    counts[at], distinct[at] = leaves.column(1).to_numpy(), leaves.column(2).to_numpy()
    n_distinct = int(distinct.sum()) + (n_ends > 0)
    n_train = int(counts.sum()) + n_ends
    own = vocabulary.value
    own_leaf = _leaves(own.shapes[own.own_place], own.own)
    np.subtract.at(counts, own_leaf, own.counts[own.own_place])
    np.subtract.at(distinct, own_leaf, 1)
    model = Digits(counts.reshape(_SHAPES, 16), distinct.reshape(_SHAPES, 16), slots)
    train_digits(train, vocabulary, model, steps)
    table = (class_log_probabilities(weights, np.arange(_CONTEXTS)) / np.log(10)).astype(np.float32).reshape(_CONTEXTS, N_CLASSES)
    return Scorer(own, n_ends, table, model), words.select("h", "c"), n_train, n_distinct


def _leaves(shape: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (shape - (N_CLASSES - _SHAPES)) * 16 + digits(h)


def _leaf_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, words = np.zeros(_SHAPES * 16, np.int64), np.zeros(_SHAPES * 16, np.int64)
    for b in batches:
        at = _leaves(b.column(0).to_numpy().astype(np.int64), b.column(2).to_numpy().view(U64))
        counts += np.bincount(at, b.column(1).to_numpy(), len(counts)).astype(np.int64)
        words += np.bincount(at, minlength=len(counts))
    some = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(words[some])], ["leaf", "c", "n"])


def score_documents(docs: DataFrame, held_fold: int = 1, places: int = 1 << 16, rounds: int = 12, rate: float = 0.5, steps: int = 4, slots: int = 1 << 13) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    places: the most words whose counts each task holds; rounds, rate: gradient steps of the classes
    and their length; steps, slots: gradient steps of the digits and slots of their features, a power
    of two.
    """
    bound_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    held = F.coalesce(fold() == held_fold, F.lit(False))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("held_out", held).withColumn("text_key", F.xxhash64("doc_id", "text"))
    model, words, n_train, n_distinct = fit(base.where("NOT held_out").select("text", "text_key"), places, rounds, rate, steps, slots)

    # Words without a place: a join by word brings their counts to the texts. Equal rows have one key.
    vocabulary, scorer = sc.broadcast(model.vocabulary), sc.broadcast(model)
    others = base.select("text", "text_key").mapInArrow(_other_words(vocabulary), "h long, text_key long, tf int")
    c = F.coalesce("c", F.lit(0))
    copies = F.count_if(F.col("tf") == 0)
    sums = others.join(words, "h", "left").groupBy("text_key").agg((F.sum(F.col("tf") * F.log10(c + 0.5)) / copies).alias("logs"), (F.sum(F.when(c > 0, F.col("tf")).otherwise(0)) / copies).cast("long").alias("n"))
    scored = base.select("text", "text_key", "doc_id", "held_out").mapInArrow(_scored(scorer), "doc_id long, text_key long, held_out boolean, n_tokens long, known long, base double, model double")
    return scored.join(sums, "text_key").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("n")).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n_tokens") * float(np.log10(n_train + 0.5 * (n_distinct + 1)))).alias("base_score"),
        (F.col("model") + F.col("logs")).alias("score"),
    )
