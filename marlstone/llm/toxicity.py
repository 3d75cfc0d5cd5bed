"""Toxicity: a lexicon learned from labels, matched through Levenshtein automata.

Words whose presence marks toxic training texts make the lexicon; prefixes that several such
words share make stems. A trie of the lexicon is intersected with the terms' Levenshtein
automata (one edit from 5 characters, two from 9) and determinised, as words reach its states, to
one table that all words of a batch step through together, so misspelled terms are caught at the
cost of a table look-up per character. Each hit has a score of the window of words around it, which
separates quotation from abuse: hits outside quotation marks add to it, misspelled ones half, and
quoted ones take from it; a hit between quotation marks scores nothing. The highest and the mean
score of a text's windows are features beside its counts of hits, quoted and not. A logistic model
on these features gives the score.

All labelled rows outside the held-out fold are fitted on: words are counted and the model's sums
added up by tasks. Every word that passes the test is kept. Stems have up to 32 characters; longer words that begin alike are terms of their own. Every text is scored whole. Nulls: a null text scores as an empty one; null labels are not learned
from; a null id keeps its row and is not held out. Without usable labels of both kinds, every
score is the share of toxic training rows (0 without any). Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textkernel as tk
from marlstone.llm.labelled import fold, training_rows
from marlstone.session import bound_batches, bound_reads, discard, durable

EXACT, FUZZY, STEM = 1, 2, 3
_WINDOW = 20
_MOST_CELLS = 8_000_000
_MOST_KNOWN = 500_000
_QUOTES = "\"«»“”„"
FEATURES = ("hits", "fuzzy", "stem", "quoted", "worst", "per_word", "windows")

_tables: dict[str, np.ndarray] = {}
_in_use: list = []


def _unicode_tables() -> dict[str, np.ndarray]:
    """By code point: whether it is white space of the word rule, alphanumeric, a quotation mark."""
    if not _tables:
        n = 0x110000
        alnum = np.zeros(n, bool)
        for c in range(0x3400):
            alnum[c] = chr(c).isalnum() or unicodedata.category(chr(c))[0] == "M"
        alnum[0x3400:] = True
        space = np.zeros(n, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        quote = np.zeros(n, bool)
        quote[[ord(c) for c in _QUOTES]] = True
        _tables.update(alnum=alnum, space=space, quote=quote)
    return _tables


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def _places(state: bytes) -> list[tuple[int, int]]:
    """The trie's nodes of a state with the edits made so far; packed, as there are tens of thousands of states."""
    return [divmod(x, 4) for x in array("i", state)]


class Automaton:
    """The trie of all terms intersected with their Levenshtein automata, determinised as words need it.

    ``step[state, symbol]`` is the next state (0: none, -1: not yet known), ``accepts[state]`` what
    a word ending there is, ``longest`` the number of characters after which no state but a stem's
    is left. States are made when a word first reaches them, so any number of terms can be held;
    where a run of words starts with a table of more than ``_MOST_CELLS``, all are dropped and made anew.
    What words are is kept by their hash, up to ``_MOST_KNOWN`` of them, so that states are made for new words only.
    """

    def __init__(self, terms: list[str], stems: list[str]) -> None:
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for t in [*terms, *stems] for c in t}))}
        self.child: list[dict[int, int]] = [{}]
        self.ends = [-1]
        self.reach = [0]
        self.stem_end = [False]
        for t in terms:
            self._add(t, edits_allowed(t), False)
        for t in stems:
            self._add(t, 0, True)
        self.longest = max([len(t) + edits_allowed(t) for t in terms] + [len(t) for t in stems], default=0)
        self.symbols: np.ndarray | None = None
        self._reset()
        self._forget()

    def _add(self, word: str, edits: int, is_stem: bool) -> None:
        at = 0
        self.reach[0] = max(self.reach[0], edits)
        for c in word:
            symbol = self.alphabet[c]
            if symbol not in self.child[at]:
                self.child[at][symbol] = len(self.child)
                self.child.append({})
                self.ends.append(-1)
                self.reach.append(0)
                self.stem_end.append(False)
            at = self.child[at][symbol]
            self.reach[at] = max(self.reach[at], edits)
        if is_stem:
            self.stem_end[at] = True
        else:
            self.ends[at] = edits

    def _closed(self, state: dict[int, int]) -> bytes | str:
        child, reach = self.child, self.reach
        stack = list(state.items())
        while stack:
            node, e = stack.pop()
            for to in child[node].values():
                if e + 1 <= reach[to] and state.get(to, 9) > e + 1:
                    state[to] = e + 1
                    stack.append((to, e + 1))
        if any(self.stem_end[x] and e == 0 for x, e in state.items()):
            return "stem"
        return array("i", [4 * x + e for x, e in sorted(state.items())]).tobytes()

    def _kind(self, state: bytes | str) -> int:
        if state == "stem":
            return STEM
        hits = [e for x, e in _places(state) if self.ends[x] >= e]
        return 0 if not hits else EXACT if min(hits) == 0 else FUZZY

    def _reset(self) -> None:
        self.ids: dict[bytes | str, int] = {}
        self.states: list[bytes | str] = []
        self.step = np.zeros((0, len(self.alphabet) + 1), np.int32)
        self.accepts = np.zeros(0, np.int8)
        self._state(b"")
        self.step[0] = 0
        self._state(self._closed({0: 0}))

    def _forget(self) -> None:
        self.known, self.known_kind = np.zeros(0, tk.U64), np.zeros(0, np.int8)

    def _state(self, state: bytes | str) -> int:
        if state not in self.ids:
            i = self.ids[state] = len(self.states)
            self.states.append(state)
            if i >= len(self.step):
                more = max(64, len(self.step))
                self.step = np.concatenate([self.step, np.full((more, self.step.shape[1]), -1, np.int32)])
                self.accepts = np.concatenate([self.accepts, np.zeros(more, np.int8)])
            self.accepts[i] = self._kind(state)
            if state == "stem":
                self.step[i] = i
        return self.ids[state]

    def _next(self, state: bytes, symbol: int) -> bytes | str:
        child, reach = self.child, self.reach
        after: dict[int, int] = {}
        for node, e in _places(state):
            if e + 1 <= reach[node]:
                after[node] = min(after.get(node, 9), e + 1)
                for label, to in child[node].items():
                    cost = e + (label != symbol)
                    if cost <= reach[to]:
                        after[to] = min(after.get(to, 9), cost)
            else:
                # No edit is left for any term through this node.
                to = child[node].get(symbol)
                if to is not None and e <= reach[to]:
                    after[to] = min(after.get(to, 9), e)
        return self._closed(after)

    def _stepped(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        to = self.step[state, symbol]
        new = to < 0
        if new.any():
            width = self.step.shape[1]
            for pair in np.unique(state[new].astype(np.int64) * width + symbol[new]).tolist():
                s, c = divmod(pair, width)
                found = self._state(self._next(self.states[s], c))
                self.step[s, c] = found
            to = self.step[state, symbol]
        return to

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("symbols", "ids", "states", "step", "accepts", "known", "known_kind")}

    def __setstate__(self, kept: dict) -> None:
        self.__dict__.update(kept, symbols=None)
        self._reset()
        self._forget()

    def symbol_table(self) -> np.ndarray:
        if self.symbols is None:
            self.symbols = np.zeros(0x110000, np.uint8 if len(self.alphabet) < 255 else np.int32)
            for c, i in self.alphabet.items():
                self.symbols[ord(c)] = i
        return self.symbols

    def match(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """What each word points[start:end] is: 0, EXACT, FUZZY or STEM."""
        if self.longest == 0 or len(start) == 0:
            return np.zeros(len(start), np.int8)
        # A worker outlives its tasks and keeps what was broadcast to it: only the automaton in use keeps states and words.
        if _in_use and _in_use[0] is not self:
            _in_use[0]._reset()
            _in_use[0]._forget()
        _in_use[:] = [self]
        words, first, of = np.unique(tk.span_hashes(points, start, end), return_index=True, return_inverse=True)
        if len(self.known) > _MOST_KNOWN:
            self._forget()
        at = np.searchsorted(self.known, words)
        old = np.zeros(len(words), bool)
        if len(self.known):
            old = self.known[np.minimum(at, len(self.known) - 1)] == words
        found = np.zeros(len(words), np.int8)
        found[old] = self.known_kind[at[old]]
        new = ~old
        found[new] = self._matched(points, start[first[new]], end[first[new]])
        self.known, self.known_kind = np.insert(self.known, at[new], words[new]), np.insert(self.known_kind, at[new], found[new])
        return found[of]

    def _matched(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        found = np.zeros(len(start), np.int8)
        if len(self.states) * self.step.shape[1] > _MOST_CELLS:
            self._reset()
        at = np.arange(len(start))
        state = np.ones(len(start), np.int32)
        pos, end = start.copy(), end
        table = self.symbol_table()
        for _ in range(self.longest + 1):
            over = pos >= end[at]
            found[at[over]] = self.accepts[state[over]]
            at, state, pos = at[~over], state[~over], pos[~over]
            if len(at) == 0:
                return found
            state = self._stepped(state, table[points[pos]])
            live = state > 0
            at, state, pos = at[live], state[live], pos[live] + 1
        found[at[self.accepts[state] == STEM]] = STEM
        return found


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, their offsets, and start, end, row of words without outer punctuation."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
    t = _unicode_tables()
    n = len(points)
    if n == 0:
        none = np.zeros(0, np.int64)
        return points, rows, none, none, none
    inside, alnum = ~t["space"][points], t["alnum"][points]
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= edge[1:-1] | ~inside[:-1]
    closes[:-1] &= edge[1:-1] | ~inside[1:]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    # Move both ends to the first and last alphanumeric character of the word.
    index = np.flatnonzero(alnum)
    if len(index) == 0:
        none = np.zeros(0, np.int64)
        return points, rows, none, none, none
    first = index[np.minimum(np.searchsorted(index, start), len(index) - 1)]
    last = index[np.maximum(np.searchsorted(index, end) - 1, 0)]
    keep = (first >= start) & (last < end) & (first <= last)
    start, end = first[keep], last[keep] + 1
    return points, rows, start, end, np.searchsorted(rows, start, "right") - 1


def text_runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of about a megabyte."""
    at, held, size = 0, [], 0
    for i, x in enumerate(column):
        s = x.as_py() or ""
        held.append(s)
        size += len(s)
        if size >= tk.CHUNK_BYTES // 2:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def window_scores(place: np.ndarray, kind: np.ndarray, quoted: np.ndarray) -> np.ndarray:
    """The score of the window around each hit; ``place`` is its word's number, rising."""
    weight = np.where(quoted, -1.0, np.where(kind == FUZZY, 0.5, 1.0))
    sums = np.concatenate(([0.0], np.cumsum(weight)))
    around = sums[np.searchsorted(place, place + _WINDOW, "right")] - sums[np.searchsorted(place, place - _WINDOW, "left")]
    return np.where(quoted, 0.0, np.maximum(0.0, around))


def features(texts: list[str], automaton: Automaton) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    points, rows, start, end, row = _words(texts)
    if len(start) == 0:
        return out
    kind = automaton.match(points, start, end)
    hit = np.flatnonzero(kind)
    if len(hit) == 0:
        return out
    n_words = np.bincount(row, minlength=len(texts))
    marks = np.concatenate(([0], np.cumsum(_unicode_tables()["quote"][points])))
    before = marks[start[hit]] - marks[rows[row[hit]]]
    after = marks[rows[row[hit] + 1]] - marks[end[hit]]
    quoted = (before % 2 == 1) & (after > 0)
    r = row[hit]
    for j, k in enumerate((EXACT, FUZZY, STEM)):
        # The first counts hits of all kinds, so that a misspelling weighs as its term until labels say otherwise.
        out[:, j] = np.bincount(r[((kind[hit] == k) | (k == EXACT)) & ~quoted], minlength=len(texts))
    out[:, 3] = np.bincount(r[quoted], minlength=len(texts))
    window = window_scores(hit + r * (4 * _WINDOW), kind[hit], quoted)  # words of different rows are never in one window
    np.maximum.at(out[:, 4], r, window)
    out[:, 5] = out[:, 0] / np.maximum(1, n_words)
    out[:, 6] = np.bincount(r, window, len(texts)) / np.maximum(1, np.bincount(r, minlength=len(texts)))
    out[:, [0, 1, 2, 3, 4, 6]] = np.log1p(out[:, [0, 1, 2, 3, 4, 6]])
    out[:, 5] = np.sqrt(out[:, 5])
    return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, texts with it that are toxic, that are not) of each batch."""
    for b in batches:
        label = b.column(1).to_pylist()
        for at, texts in text_runs(b.column(0)):
            points, _, start, end, row = _words(texts)
            raw = points.astype("<u4").tobytes()
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            bounds = tk.row_slices(row, len(texts))
            for r in range(len(texts)):
                s, e = start[bounds[r] : bounds[r + 1]], end[bounds[r] : bounds[r + 1]]
                counts[1 if label[at + r] else 0].update({raw[4 * x : 4 * y] for x, y in zip(s.tolist(), e.tolist(), strict=True)})
            found = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode("utf-32-le", "surrogatepass").encode("utf-8", "replace").decode() for w in found], pa.string()), pa.array([counts[1][w] for w in found], pa.int64()), pa.array([counts[0][w] for w in found], pa.int64())],
                ["word", "n_toxic", "n_clean"],
            )


def learn_lexicon(words: DataFrame, n_toxic: int, n_clean: int, least: int = 4) -> tuple[list[str], list[str]]:
    """All terms and stems from (word, n_toxic, n_clean). A term is in ``least`` of the counted texts, which bounds what the driver gets."""
    share = n_toxic / max(1, n_toxic + n_clean)
    bar = max(0.5 * (1 + share), 0.75)
    # Seen in enough toxic texts, and toxic far more often than a text at large.
    significant = lambda at_least: (F.col("n_toxic") >= at_least) & ((F.col("n_toxic") + share) / (F.col("n_toxic") + F.col("n_clean") + 1) >= bar)
    marked = words.withColumn("size", F.char_length("word")).withColumn("likely", significant(least) & (F.col("size") >= 3))
    terms = [r["word"] for r in marked.where("likely").orderBy(F.desc("n_toxic"), "word").select("word").collect()]
    # A stem begins four terms at least, and all words that it begins are toxic together.
    begun = marked.where("size >= 4").select("n_toxic", "n_clean", "likely", "size", F.explode(F.sequence(F.lit(4), F.least(F.col("size"), F.lit(32)))).alias("k"), "word")
    counted = begun.groupBy(F.substring("word", F.lit(1), F.col("k")).alias("prefix")).agg(
        F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"), F.count_if(F.col("likely") & (F.col("k") < F.col("size"))).alias("n_terms")
    )
    stems: set[str] = set()
    starts = lambda w: any(w[:k] in stems for k in range(4, len(w) + 1))
    for p in sorted((r["prefix"] for r in counted.where(significant(3 * least) & (F.col("n_terms") >= 4)).select("prefix").collect()), key=lambda p: (len(p), p)):
        if not starts(p):
            stems.add(p)
    return [w for w in terms if not starts(w)], sorted(stems)


def logistic_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The loss of the weights ``w`` (the constant first) over rows, its gradient and its curvature, in one array."""
    a = np.column_stack([np.ones(len(x)), x])
    z = a @ w
    p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    return np.concatenate([[np.logaddexp(0, z).sum() - y @ z], a.T @ (p - y), ((a * (p * (1 - p) + 1e-9)[:, None]).T @ a).ravel()])


def fit_logistic(sums: Callable[[np.ndarray], np.ndarray], n_features: int, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression (the constant first) by Newton steps with halving; ``sums`` gives ``logistic_sums`` over all rows."""
    n = n_features + 1
    w = np.zeros(n)
    penalty = np.full(n, ridge)
    penalty[0] = 1e-6

    def at(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        found = sums(v)
        return float(found[0] + 0.5 * (penalty * v * v).sum()), found[1 : n + 1] + penalty * v, found[n + 1 :].reshape(n, n) + np.diag(penalty)

    now, slope, curve = at(w)
    for _ in range(rounds):
        step, scale = np.linalg.solve(curve, -slope), 1.0
        tried = at(w + step)
        while scale > 1e-4 and tried[0] > now:
            scale /= 2
            tried = at(w + scale * step)
        w, (now, slope, curve) = w + scale * step, tried
        if np.abs(scale * step).max() < 1e-8:
            break
    return w


def _train_features(automaton: Automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [features(texts, automaton) for _, texts in text_runs(b.column(0))]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), b.column(1)], [*FEATURES, "label"])

    return run


class Model:
    """A fitted toxicity scorer."""

    def __init__(self, automaton: Automaton, weights: np.ndarray, terms: list[str], stems: list[str]) -> None:
        self.automaton, self.weights, self.terms, self.stems = automaton, weights, terms, stems

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.weights[0] + features(texts, self.automaton) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, held_fold: int = 0) -> Model:
    """Learn the lexicon and the weights from all labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    bound_batches(spark)
    bound_reads(spark)
    labelled = training_rows(docs, labels, "toxic", held_fold)
    train = labelled.select("text", "label")
    words = durable(train.mapInArrow(_word_counts, "word string, n_toxic long, n_clean long").groupBy("word").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean")))
    totals = {int(r["label"] != 0): r["k"] for r in train.groupBy((F.col("label") != 0).cast("int").alias("label")).agg(F.count("*").alias("k")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        w = np.zeros(1 + len(FEATURES))
        w[0] = 35.0 if toxic else -35.0
        return Model(Automaton([], []), w, [], [])
    terms, stems = learn_lexicon(words, toxic, clean)
    automaton = Automaton(terms, stems)
    shared = spark.sparkContext.broadcast(automaton)
    columns = ", ".join(f"{f} double" for f in FEATURES) + ", label int"
    rows = durable(train.mapInArrow(_train_features_shared(shared), columns))
    weights = fit_logistic(lambda w: _summed(rows, w), len(FEATURES))
    for read in (words, rows, labelled):
        if hasattr(read, "durable_path"):  # the texts only where they were shuffled
            discard(read)
    return Model(automaton, weights, terms, stems)


def _summed(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """``logistic_sums`` over all rows of features: one array of each task, added in the order of the tasks, so that reruns agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + len(w) + len(w) ** 2)
        for b in batches:
            total += logistic_sums(np.column_stack([c.to_numpy() for c in b.columns[:-1]]), (b.column(len(FEATURES)).to_numpy() != 0).astype(float), w)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return np.sum([np.frombuffer(r["sums"]) for r in rows.mapInArrow(run, "sums binary").collect()], axis=0)


def _train_features_shared(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _train_features(shared.value)(batches)

    return run


def score(docs: DataFrame, model: Model, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and the columns named in ``extra`` of every row."""
    bound_batches(docs.sparkSession)
    bound_reads(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "score", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [shared.value.score(texts) for _, texts in text_runs(b.column(1))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), *(b.column(2 + i) for i in range(len(extra)))], names)
        pa.default_memory_pool().release_unused()  # the worker stays for later stages

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("__text"), *extra)
    types = dict(docs.dtypes)
    return base.mapInArrow(run, ", ".join(["doc_id long", "score double", *(f"`{c}` {types[c]}" for c in extra)]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every document."""
    scored = score(docs, fit(docs, labels))
    held = F.coalesce(fold() == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
