"""Ranked lexical search of many items over all documents by a threshold-seeded join.

Terms are maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased. A term of a
document has an impact: the term's weight w = floor(1000 ln((2N + 2) / (2 df + 1))) times
(10^9 tf) div (1000 tf + 20 m), where m = 100 - b + (b n N) div L grows with the document's length
n. A document's score for an item is the sum of the impacts of the item's terms.

1. Documents are cut to their length and the terms that any item asks for, once, and written.
   N, L and df are counted over all of them.
2. For each term its k-th highest impact and its highest are found (partial lists in each task,
   merged in two levels). k documents score at least a term's k-th impact, so the largest of these
   over an item's terms is a threshold that its k-th score reaches: documents below it are no result.
3. An item's terms are ordered by their highest impact. Those at the end whose highest impacts sum
   to less than the threshold are pruned: documents that hold only such terms stay below it.
4. Each document meets the items of its terms that are left. A pair whose sum so far and the bound
   of the pruned terms reach the threshold is a candidate, and is scored exactly with the pruned terms.
   A task keeps k results an item, which raise its thresholds as it goes on; lists are merged
   in two levels.

Postings are never shuffled by term: a document's terms lie in its own row, so a term that every
document holds makes no hot key. What is broadcast are an item block's terms: items are dealt in
blocks of about ``block_terms`` (item, term) pairs, and a block's pass follows the other. An item is
not split.

Nulls: a null text has no terms; documents without terms count nowhere. Every row of the documents
is a document of its own, repeated ids included; rows without id come last among equal scores.
Rows of one item id make one item with the terms of all; items without id, without terms or without
a hit have no results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textkernel as tk
from marlstone.session import bound_batches, discard, durable

#: Characters outside terms (fixed by the rule): ASCII but for letters and digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[:0x80] = [not (chr(c).isdigit() or chr(c).isalpha()) for c in range(0x80)]
_CELLS = 1 << 21  # of sums by document and item, and of looked-up terms, at a time
_FAN = 256


@dataclass
class _Items:
    """An item block: terms by number, and each item's terms."""

    terms: list[bytes]
    ids: list[int]
    first: np.ndarray  # of each item in ``term``; one more at the end
    term: np.ndarray
    hashes: np.ndarray = field(default=None)
    order: np.ndarray = field(default=None)
    pool: np.ndarray = field(default=None)
    at: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        """Hashes in ascending order, and all terms' bytes behind one another."""
        self.pool = np.frombuffer(b"".join(self.terms), np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(t) for t in self.terms]))).astype(np.int64)
        hashes = tk.span_hashes(self.pool, self.at[:-1], self.at[1:])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def numbers(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each span's term, or -1. Spans with a known hash are compared byte by byte."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.hashes) or not len(start):
            return out
        h = tk.span_hashes(raw, start, end)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = np.flatnonzero(self.hashes[place] == h)
        number, size = self.order[place[known]], (end - start)[known]
        fits = size == np.diff(self.at)[number]
        known, number, size = known[fits], number[fits], size[fits]
        if len(known):
            before = np.cumsum(size) - size
            step = np.arange(int(size.sum())) - np.repeat(before, size)
            differs = raw[np.repeat(start[known], size) + step] != self.pool[np.repeat(self.at[number], size) + step]
            equal = np.add.reduceat(differs, before) == 0
            out[known[equal]] = number[equal]
        return out


def _postings(items: _Items):
    """(doc_id, n, terms, tfs) of each document that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, raw, rows in tk.chunks(b.column(1)):
                low = tk.LOWER[raw]
                start, end, row = tk.word_bounds(low, rows, _SEPARATOR)
                n = np.bincount(row, minlength=to - at)
                number = items.numbers(low, start, end)
                hit = number >= 0
                keys, tf = np.unique(row[hit] * len(items.terms) + number[hit], return_counts=True)
                edges = np.searchsorted(keys, np.arange(to - at + 1) * len(items.terms)).astype(np.int32)
                flat = pa.array((keys % max(1, len(items.terms))).astype(np.int32)), pa.array(tf.astype(np.int32))
                lists = [pa.ListArray.from_arrays(pa.array(edges), x) for x in flat]
                batch = pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])
                yield batch.filter(pa.array(n > 0))

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row of each."""
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


def _document_counts(n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            df += np.bincount(_flat(b.column(0))[0], minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    return run


@dataclass
class _Scale:
    """What turns counts into impacts."""

    weight: np.ndarray
    documents: int
    length: int
    b: int

    def impacts(self, n: np.ndarray, term: np.ndarray, tf: np.ndarray, row: np.ndarray) -> np.ndarray:
        if self.b * int(n.max(initial=0)) * self.documents < 2**63:
            m = 100 - self.b + (self.b * n * self.documents) // self.length
        else:
            m = np.array([100 - self.b + (self.b * int(x) * self.documents) // self.length for x in n], np.int64)
        tf = tf.astype(np.int64)
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))


def _best(group: np.ndarray, key: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the first k of each group in the order of ``key`` (most significant last)."""
    order = np.lexsort((*key, group))
    g = group[order]
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    return order[np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g)))) < k]


def _term_tops(scale: _Scale, k: int):
    """(term, top) with the k highest impacts of each term in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, tops = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            term, row = _flat(b.column(1))
            impact = scale.impacts(b.column(0).to_numpy(), term, _flat(b.column(2))[0], row)
            terms, tops = np.concatenate([terms, term]), np.concatenate([tops, impact])
            keep = _best(terms, [-tops], k)
            terms, tops = terms[keep], tops[keep]
        if len(terms):
            edges = np.append(np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))), len(terms)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(terms[edges[:-1]]), pa.ListArray.from_arrays(pa.array(edges), pa.array(tops))], ["term", "top"])

    return run


@dataclass
class _Plan:
    """For each item its threshold, the bound of its pruned terms, and who is asked for by which term."""

    threshold: np.ndarray
    bound: np.ndarray
    first: np.ndarray  # of each term in ``item``: the items that it seeds
    item: np.ndarray
    pruned_first: np.ndarray  # of each item in ``pruned``
    pruned: np.ndarray


def pruned_plan(items: _Items, kth: np.ndarray, most: np.ndarray) -> _Plan:
    """Thresholds and the split of every item's terms into seeds and pruned ones."""
    n = len(items.ids)
    threshold, bound = np.zeros(n, np.int64), np.zeros(n, np.int64)
    seeds, pruned = [], []
    for i in range(n):
        terms = items.term[items.first[i] : items.first[i + 1]]
        threshold[i] = kth[terms].max(initial=0)
        order = terms[np.argsort(-most[terms], kind="stable")]
        suffix = np.cumsum(most[order][::-1])  # of the last 1, 2, ... terms
        cut = int(np.searchsorted(suffix, threshold[i], "left"))
        bound[i] = suffix[cut - 1] if cut else 0
        seeds.append(order[: len(order) - cut])
        pruned.append(order[len(order) - cut :])
    sizes = np.array([len(s) for s in seeds], np.int64)
    term = np.concatenate([*seeds, np.zeros(0, np.int64)])
    by_term = np.argsort(term, kind="stable")
    return _Plan(threshold, bound, np.searchsorted(term[by_term], np.arange(len(items.terms) + 1)), np.repeat(np.arange(n), sizes)[by_term], np.concatenate(([0], np.cumsum([len(p) for p in pruned]))).astype(np.int64), np.concatenate([*pruned, np.zeros(0, np.int64)]).astype(np.int64))


def _spread(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of ``which`` all places of its list: (entry, place)."""
    size = first[which + 1] - first[which]
    entry = np.repeat(np.arange(len(which)), size)
    return entry, np.repeat(first[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class _Scorer:
    """One task's results, with thresholds that rise as lists fill."""

    def __init__(self, scale: _Scale, plan: _Plan, n_terms: int, k: int) -> None:
        self.scale, self.plan, self.n_terms, self.k = scale, plan, n_terms, k
        self.threshold = plan.threshold.copy()
        self.lists = [np.zeros(0, np.int64)] * 4  # item, without id, id, score

    def add(self, doc_id: np.ndarray, missing: np.ndarray, n: np.ndarray, term: np.ndarray, tf: np.ndarray, row: np.ndarray) -> None:
        plan, n_items = self.plan, len(self.threshold)
        impact = self.scale.impacts(n, term, tf, row)
        step = max(1, _CELLS // max(1, n_items))
        for a in range(0, len(n), step):
            lo, hi = np.searchsorted(row, (a, a + step))
            own_row, own_term, own_impact = row[lo:hi] - a, term[lo:hi].astype(np.int64), impact[lo:hi]
            entry, place = _spread(plan.first, own_term)
            cell = own_row[entry] * n_items + plan.item[place]
            rows_here = min(step, len(n) - a)
            sums = np.zeros(rows_here * n_items, np.int64)
            np.add.at(sums, cell, own_impact[entry])
            some = np.flatnonzero(sums)
            item = some % n_items
            some = some[sums[some] + plan.bound[item] >= self.threshold[item]]
            # Exact scores: a document's terms are in ascending order, so a pruned term is looked up.
            keys = own_row * self.n_terms + own_term
            pruned = np.cumsum(np.diff(plan.pruned_first)[some % n_items])
            at = 0
            while at < len(some):
                to = max(at + 1, int(np.searchsorted(pruned, (pruned[at - 1] if at else 0) + _CELLS, "right")))
                part = some[at:to]
                item, doc, score = part % n_items, part // n_items, sums[part]
                entry, place = _spread(plan.pruned_first, item)
                wanted = doc[entry] * self.n_terms + plan.pruned[place]
                spot = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
                found = keys[spot] == wanted if len(keys) else np.zeros(0, bool)
                np.add.at(score, entry[found], own_impact[spot[found]])
                keep = score >= np.maximum(self.threshold[item], 1)
                item, doc, score = item[keep], doc[keep] + a, score[keep]
                self._hold([item, missing[doc], doc_id[doc], score])
                at = to

    def _hold(self, more: list[np.ndarray]) -> None:
        self.lists = [np.concatenate(x) for x in zip(self.lists, more, strict=True)]
        if len(self.lists[0]) > max(_CELLS // 4, 4 * self.k * len(self.threshold)):
            self._cut()

    def _cut(self) -> None:
        item, missing, doc, score = self.lists
        keep = _best(item, [doc, missing, -score], self.k)
        self.lists = [x[keep] for x in self.lists]
        # An item with k results here needs the score of the last of them at least.
        full = np.flatnonzero(np.bincount(self.lists[0], minlength=len(self.threshold)) == self.k)
        last = np.searchsorted(self.lists[0], full, "right") - 1
        self.threshold[full] = np.maximum(self.threshold[full], self.lists[3][last])

    def results(self) -> list[np.ndarray]:
        self._cut()
        return self.lists


def _scores(scale: _Scale, plan: _Plan, n_terms: int, k: int):
    """(item, doc_id, score) of each item's best in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(scale, plan, n_terms, k)
        for b in batches:
            ids = b.column(0)
            term, row = _flat(b.column(2))
            scorer.add(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_numpy(), term, _flat(b.column(3))[0], row)
        item, missing, doc, score = scorer.results()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, pa.int64(), mask=missing.astype(bool)), pa.array(score)], ["item", "doc_id", "score"])

    return run


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term) once each."""
    low = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(low, F.lit(TERM), 0)
    return items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.explode(found).alias("term")).distinct()


def _collected(pairs: DataFrame) -> _Items:
    """A block's items; its size was counted."""
    rows = sorted((r["item_id"], r["term"]) for r in pairs.collect())
    terms = sorted({t for _, t in rows})
    number = {t: i for i, t in enumerate(terms)}
    ids = sorted({i for i, _ in rows})
    first = np.searchsorted(np.array([i for i, _ in rows], np.int64), np.array(ids, np.int64))
    return _Items([t.encode() for t in terms], ids, np.append(first, len(rows)), np.array([number[t] for _, t in rows], np.int64))


def _two_levels(df: DataFrame, group: str, one, name: str, k: int, ascending: bool) -> DataFrame:
    """The first k entries of each group: of up to _FAN parts of its rows, then of all."""
    first = lambda array: F.slice(F.sort_array(array, ascending), 1, k)
    parts = df.select(group, F.pmod(F.spark_partition_id(), F.lit(_FAN)).alias("part"), one.alias(name)).groupBy(group, "part").agg(first(F.flatten(F.collect_list(name))).alias(name))
    return parts.groupBy(group).agg(first(F.flatten(F.collect_list(name))).alias(name))


def _search_block(docs: DataFrame, items: _Items, k: int, b: int) -> DataFrame:
    spark = docs.sparkSession
    held = durable(docs.mapInArrow(_postings(items), "doc_id long, n long, terms array<int>, tfs array<int>"))
    documents, length = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_terms = len(items.terms)
    weight, kth, most = (np.zeros(n_terms, np.int64) for _ in range(3))
    counted = held.select("terms").mapInArrow(_document_counts(n_terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for term, df in counted.collect():
        weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    scale = _Scale(weight, documents, max(1, length), b)
    tops = held.select("n", "terms", "tfs").mapInArrow(_term_tops(scale, k), "term long, top array<long>")
    for term, top in _two_levels(tops, "term", F.col("top"), "top", k, False).collect():
        most[term], kth[term] = top[0], top[k - 1] if len(top) == k else 0
    plan = pruned_plan(items, kth, most)
    found = held.mapInArrow(_scores(scale, plan, n_terms, k), "item long, doc_id long, score long")
    # Ascending: highest score first, rows without id last, then by id.
    one = F.array(F.struct((-F.col("score")).alias("minus"), F.col("doc_id").isNull().alias("missing"), "doc_id"))
    best = _two_levels(found, "item", one, "best", k, True)
    ids = spark.createDataFrame(pa.table({"item": pa.array(range(len(items.ids)), pa.int64()), "item_id": pa.array(items.ids, pa.int64())}))
    ranked = best.join(F.broadcast(ids), "item").select("item_id", F.posexplode("best").alias("at", "b"))
    out = durable(ranked.select("item_id", (F.col("at") + 1).alias("rank"), F.col("b.doc_id").alias("doc_id"), (-F.col("b.minus")).alias("score")))
    discard(held)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, b: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = 500_000) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents with a score above 0.

    b: percent of the length that counts. block_terms: (item, term) pairs of a block, which the driver
    and each task hold.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pairs = durable(item_terms(items, item_col, item_text_col))
    total = pairs.count()
    blocks = max(1, -(-2 * total // block_terms)) if total > block_terms else 1
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    parts = []
    for n in range(blocks):
        block = _collected(dealt.where(F.col("block") == n))
        if block.ids:
            parts.append(_search_block(base, block, k, b))
    discard(pairs)
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)
