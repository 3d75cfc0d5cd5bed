"""N-gram Jaccard join: size-aware, with a light way for small sets and a heavy way for large ones.

A document's set holds its distinct shingles of ``width`` words. Two sets link when
100 * |A & B| >= percent * |A | B|. The join is exact:

* Light: both sets hold at most ``boundary`` shingles. A linked pair of sizes n <= m shares at
  least ceil(percent * m / 100) shingles, so each set lists all its subsets of those fixed sizes
  and two linked sets meet in one subset.
* Heavy: the larger set exceeds the boundary. Single shingles make lists without bound (licence
  lines, shared passages), so the inverted lists are keyed by blocks: the hash range is cut in
  more blocks than linked sets of that size class can differ in, and two linked sets must agree
  on the whole content of one block. Only near copies share whole blocks.
* The boundary is the one with the lowest cost over the histogram of set sizes.

Sets that are equal are one class from the start. Classes that lists connect form a cluster;
it is cut by sizes and by parity sketches, which differ in no more bits than their sets differ in
shingles. What stays together is packed in blocks of whole sets, and every two sets of a block are
verified by a product of their incidence vectors over the shingles that they share. A cluster of several blocks
is compared with its first block, and then block by block wherever sets are still in different
components. Pairs never become rows, no list is capped, and no link between components is lost.

Sets are compared as 64-bit hashes of shingles, and a class is known by a 64-bit hash of its set.

Nulls: a null or blank text has an empty set and links with nothing; a row without an id keeps
its set size and has no component. Repeated ids and rows are rows of their own. Columns besides
the id and the text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import textkernel as tk
from marlstone.llm.components import connected_components, forest
from marlstone.session import bound_batches, durable

U64 = np.uint64
_STEP = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_MASK = 2**64 - 1
_SKETCH_SETS, _SKETCH_BYTES = 1024, 1 << 20
_FEWEST_BITS, _MOST_BITS = 256, 1 << 16
_EMPTY_LEVELS = 4
_CLASS_RATIO = 0.75
_MOST_SUBSETS = 400


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of a string column."""
    for at, to, raw, rows in tk.chunks(column):
        h, row, _, _ = tk.words(raw, rows)
        bounds = tk.row_slices(row, to - at)
        if len(h) >= width:
            grams = h[: len(h) - width + 1] * _STEP[0]
            for j in range(1, width):
                grams = grams + h[j : len(h) - width + 1 + j] * _STEP[j % 8] * U64(2 * (j // 8) + 1)
            grams = tk.mix64(grams + U64(width))
        for r in range(to - at):
            s, e = bounds[r], bounds[r + 1]
            if e == s:
                yield at + r, np.zeros(0, U64)
            elif e - s < width:
                whole = sum(int(x) * int(_STEP[j % 8]) * (2 * (j // 8) + 1) for j, x in enumerate(h[s:e]))
                yield at + r, tk.mix64(np.array([(whole + int(e - s)) & (2**64 - 1)], U64))
            else:
                a = np.sort(grams[s : e - width + 1])
                yield at + r, a[np.concatenate(([True], a[1:] != a[:-1]))]


def set_key(a: np.ndarray) -> int:
    """The 64-bit key of a set's class, as a signed long."""
    total = int(tk.mix64(a ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)) + len(a) * int(_STEP[3])
    return int(tk.signed(tk.mix64(np.array([total & _MASK], U64)))[0])


def sketch_bits(n: int) -> int:
    """Bits of the sketch of a set of n shingles: about two for each, so that unlike sets show it at any size."""
    return min(_MOST_BITS, max(_FEWEST_BITS, 1 << max(0, 2 * n - 1).bit_length()))


def sketch(a: np.ndarray) -> bytes:
    """Parities of the shingles in each of ``sketch_bits`` hash classes.

    Two sketches differ in no more bits than their sets differ in shingles, also after the longer
    one's halves were added up to the shorter one's length.
    """
    bits = sketch_bits(len(a))
    return np.packbits((np.bincount((a & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            parity: list[bytes] = [b""] * b.num_rows
            for r, a in shingle_sets(b.column(1), width):
                n[r] = len(a)
                if len(a):
                    key[r], parity[r] = set_key(a), sketch(a)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(key), pa.array(parity, pa.binary())], ["doc_id", "n_shingles", "set_key", "sketch"])

    return run


class Plan:
    """Where subsets end and lists begin, and how many blocks a size class needs."""

    def __init__(self, percent: int, boundary: int) -> None:
        self.percent, self.boundary = percent, boundary
        self.tops: list[int] = [0]

    def _top(self, i: int) -> int:
        while len(self.tops) <= i:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] / _CLASS_RATIO)))
        return self.tops[i]

    def size_class(self, n: int) -> int:
        i = 1
        while self._top(i) < n:
            i += 1
        return i

    def largest_partner(self, n: int) -> int:
        return 100 * n // self.percent

    def blocks(self, i: int) -> tuple[int, int]:
        """Blocks for pairs whose smaller set is of class i, and how many agree at least."""
        top = self._top(i)
        both = top + self.largest_partner(top)
        # |A ^ B| = n + m - 2 |A & B| and |A & B| >= percent (n + m) / (100 + percent).
        differ = (100 - self.percent) * both // (100 + self.percent)
        spare = 1 + (differ + 1) // 10
        return differ + spare, spare

    def classes_of(self, n: int) -> list[int]:
        """The classes in which a set of n shingles is listed: its own, and those it is the larger partner of."""
        own = self.size_class(n)
        found, i = [own], own - 1
        while i >= 1 and self.largest_partner(self._top(i)) >= n:
            found.append(i)
            i -= 1
        return found

    def overlaps(self, n: int, most: int) -> list[int]:
        """Subset sizes that a set of n shingles lists so as to meet every linked set of up to ``most``."""
        return sorted({-(-self.percent * m // 100) for m in range(n, min(most, self.largest_partner(n)) + 1)})

    def n_subsets(self, n: int, most: int) -> int:
        return sum(math.comb(n, c) for c in self.overlaps(n, most))

    def n_blocks(self, n: int) -> int:
        return sum(self.blocks(i)[0] for i in self.classes_of(n))


def choose_boundary(sizes: dict[int, int], percent: int, largest: int = 24) -> int:
    """The boundary with the lowest cost: entries listed, plus the expected chance meetings in short blocks.

    A block of few shingles is met by sets that share only a common phrase; an entry for it
    counts double for each e-fold that it is shorter.
    """
    plan = Plan(percent, 0)

    def cost(b: int) -> float:
        light = sum(k * plan.n_subsets(n, b) for n, k in sizes.items() if n <= b)
        heavy = sum(k * nb * (1 + 8 * math.exp(-n / max(1, plan.blocks(plan.size_class(n))[0]) / 2)) for n, k in sizes.items() if n * 100 >= (b + 1) * percent and (nb := plan.n_blocks(n)))
        return light + heavy

    allowed = [b for b in range(largest + 1) if all(plan.n_subsets(n, b) <= _MOST_SUBSETS for n in range(1, b + 1))]
    return min(allowed, key=lambda b: (cost(b), b))


def _range_starts(a: np.ndarray, blocks: int) -> np.ndarray:
    edges = (np.arange(blocks, dtype=np.float64) * (2.0**64 / blocks)).astype(U64)
    return np.searchsorted(a, edges, "left")


def signatures(a: np.ndarray, plan: Plan) -> np.ndarray:
    """All list keys of one set."""
    n = len(a)
    found: list[np.ndarray] = []
    if 0 < n <= plan.boundary:
        m = tk.mix64(a ^ U64(0x2545F4914F6CDD1D))
        whole = m.sum(dtype=U64)
        for c in plan.overlaps(n, plan.boundary):
            left_out = np.array([sum(int(m[i]) for i in x) & (2**64 - 1) for x in combinations(range(n), n - c)], U64)
            found.append(tk.mix64((whole - left_out) + U64((c * int(_STEP[1]) + 7) & _MASK)))
    if n * 100 >= (plan.boundary + 1) * plan.percent:
        for i in plan.classes_of(n):
            blocks, spare = plan.blocks(i)
            for level in range(_EMPTY_LEVELS):
                b = a if level == 0 else np.sort(tk.mix64(a + U64(level) * _STEP[2]))
                starts = _range_starts(b, blocks)
                sums = np.zeros(n + 1, U64)
                np.cumsum(tk.mix64(b ^ U64(0x632BE59BD9B4E019)), out=sums[1:])
                ends = np.append(starts[1:], n)
                keys = tk.mix64(sums[ends] - sums[starts] + (np.arange(blocks, dtype=U64) + U64(1)) * _STEP[4] + U64((i * 8 + level) * int(_STEP[5]) & _MASK))
                full = ends > starts
                empties = blocks - int(full.sum())
                last = level == _EMPTY_LEVELS - 1
                found.append(keys if last else keys[full])
                # At least ``spare`` blocks agree; with fewer empty ones, one that agrees is listed.
                if empties < spare or last:
                    break
    return np.concatenate(found) if found else np.zeros(0, U64)


def _list_entries(width: int, percent: int, boundary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(percent, boundary)
        seen: set[int] = set()
        for b in batches:
            keys, sets, held = [], [], 0
            for _, a in shingle_sets(b.column(1), width):
                if len(a) == 0:
                    continue
                key = set_key(a)
                if key in seen:  # a copy of a set that this task has listed
                    continue
                if len(seen) < 1 << 18:
                    seen.add(key)
                s = signatures(a, plan)
                keys.append(s)
                sets.append(np.full(len(s), key, np.int64))
                held += len(s)
                if held >= 1 << 17:
                    yield _entries(keys, sets)
                    keys, sets, held = [], [], 0
            if keys:
                yield _entries(keys, sets)

    return run


def _entries(keys: list, sets: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tk.signed(np.concatenate(keys))), pa.array(np.concatenate(sets))], ["list_key", "set_key"])


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries sorted by list and set: the distinct ones of lists that hold more than one set."""
    carry: tuple[int, int] | None = None
    joined = False  # whether the carried entry's list already has another set
    for b in batches:
        k, s = b.column(0).to_numpy(), b.column(1).to_numpy()
        if carry is not None:
            k, s = np.append(carry[0], k), np.append(carry[1], s)
        if len(k) == 0:
            continue
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        k, s = k[new], s[new]
        same = k[1:] == k[:-1]
        shared = np.zeros(len(k), bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared[0] |= joined
        out = shared.copy()
        out[-1] = False
        joined, carry = bool(shared[-1]), (k[-1], s[-1])
        yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(s[out])], ["list_key", "set_key"])
    if carry is not None and joined:
        yield pa.RecordBatch.from_arrays([pa.array([carry[0]], pa.int64()), pa.array([carry[1]], pa.int64())], ["list_key", "set_key"])


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sets, held = [], [], 0
            for _, a in shingle_sets(b.column(1), width):
                if len(a):
                    keys.append(set_key(a))
                    sets.append(tk.signed(a))
                    held += len(a)
                if held >= 1 << 19:
                    yield _packed(keys, sets)
                    keys, sets, held = [], [], 0
            if keys:
                yield _packed(keys, sets)

    return run


def _packed(keys: list, sets: list) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["set_key", "shingles"])


_BLOCK_SETS, _BLOCK_SHINGLES = 256, 1 << 17
_SMALL = 1_000_000
_BLOCK = "cluster long, last_cluster long, block long, lo long, hi long, least long, most long, keys binary, roots binary, clusters binary, sizes binary, shingles binary"


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast a table of a few longs if it was counted to be small; else leave the join to shuffle."""
    return F.broadcast(df) if df.count() <= _SMALL else df


def _pack_blocks(most_sets: int, most_shingles: int):
    """Blocks from rows (cluster, bucket, root, set_key, shingles) sorted by cluster, and by size in large ones.

    Bucket 0 holds whole clusters, which stay together; a block ends where a new one does not
    fit. Larger clusters have bucket 1, and blocks of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple | None = None
        held: list[tuple] = []  # (cluster, root, set_key, shingles)
        size = 0
        names = [x.split()[0] for x in _BLOCK.split(", ")]
        types = [pa.int64()] * 7 + [pa.binary()] * 5

        def close() -> pa.RecordBatch:
            nonlocal held, size
            clusters, roots, keys = (np.array([h[i] for h in held], np.int64) for i in range(3))
            sets = [h[3] for h in held]
            sizes = np.array([len(x) for x in sets], np.int64)
            row = [clusters[0], clusters[-1], int(keys[0]), roots.min(), roots.max(), sizes.min(), sizes.max(), keys.tobytes(), roots.tobytes(), clusters.tobytes(), sizes.tobytes(), np.concatenate(sets).tobytes()]
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for b in batches:
            cluster, bucket, root, key = (b.column(i).to_pylist() for i in range(4))
            lists = b.column(4)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i in range(b.num_rows):
                now = (cluster[i], bucket[i])
                if held and held[-1][2] == key[i] and held[-1][0] == cluster[i]:  # a repeated id
                    continue
                a = flat[offsets[i] : offsets[i + 1]]
                full = len(held) >= most_sets or size + len(a) > most_shingles
                if held and ((full and (bucket[i] or now != place)) or (now != place and (bucket[i] or place[1]))):
                    yield close()
                place = now
                held.append((cluster[i], root[i], key[i], a.copy()))
                size += len(a)
        if held:
            yield close()

    return run


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """|x & y| of every x in a and y in b, over the shingles that occur on both sides."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)
    if len(both) == 0:
        return out.astype(np.int64)
    at_a, at_b = np.searchsorted(both, flat_a), np.searchsorted(both, flat_b)
    ok_a, ok_b = both[np.minimum(at_a, len(both) - 1)] == flat_a, both[np.minimum(at_b, len(both) - 1)] == flat_b
    at_a, row_a, at_b, row_b = at_a[ok_a], row_a[ok_a], at_b[ok_b], row_b[ok_b]
    for lo in range(0, len(both), 8192):
        width = min(8192, len(both) - lo)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        for m, at, row in ((x, at_a, row_a), (y, at_b, row_b)):
            own = (at >= lo) & (at < lo + width)
            m[row[own], at[own] - lo] = 1
        out += x @ y.T
    return out.astype(np.int64)


_SKETCHES = "cluster long, block long, least long, most long, keys binary, clusters binary, sizes binary, sketches binary"


def _pack_sketches(most_sets: int, most_bytes: int):
    """Blocks of (cluster, bucket, set_key, n, sketch) rows, in the order of ``_pack_blocks``; bucket 0 holds whole clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SKETCHES.split(", ")]
        types = [pa.int64()] * 4 + [pa.binary()] * 4
        held: list[tuple] = []
        place: tuple | None = None
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size
            clusters, keys, sizes = (np.array([h[i] for h in held], np.int64) for i in range(3))
            row = [clusters[0], keys[0], sizes.min(), sizes.max(), keys.tobytes(), clusters.tobytes(), sizes.tobytes(), b"".join(h[3] for h in held)]
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for b in batches:
            for cluster, bucket, key, n, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                now = (cluster, bucket)
                full = len(held) >= most_sets or size + len(bits) > most_bytes
                if held and ((full and (bucket or now != place)) or (now != place and (bucket or place[1]))):
                    yield close()
                place = now
                held.append((cluster, key, n, bits))
                size += len(bits)
        if held:
            yield close()

    return run


def _by_length(sizes: np.ndarray, sketches: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The rows whose sketches have a length, and the sketches as words of 64 bits, by length."""
    bits = np.array([sketch_bits(n) for n in sizes.tolist()], np.int64)
    starts = np.concatenate(([0], np.cumsum(bits // 64)))
    flat = np.frombuffer(sketches, U64)
    return {int(k): (rows := np.flatnonzero(bits == k), flat[starts[rows][:, None] + np.arange(k // 64)]) for k in np.unique(bits)}


def _folded(s: np.ndarray, words: int) -> np.ndarray:
    while s.shape[1] > words:
        s = s[:, : s.shape[1] // 2] ^ s[:, s.shape[1] // 2 :]
    return s


def _alike(x: tuple, y: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the sets of two blocks whose sizes and sketches let them link."""
    (xk, xc, xn), (yk, yc, yn) = ([np.frombuffer(p[i], np.int64) for i in range(3)] for p in (x, y))
    rows, columns = [], []
    for xi, xs in _by_length(xn, x[3]).values():
        for yi, ys in _by_length(yn, y[3]).values():
            words = min(xs.shape[1], ys.shape[1])
            if 100 * min(xn[xi].max(), yn[yi].max()) < percent * max(xn[xi].min(), yn[yi].min()):
                continue
            a, b = _folded(xs, words), _folded(ys, words)
            step = max(1, (1 << 22) // (words * len(yi)))
            for lo in range(0, len(xi), step):
                i = xi[lo : lo + step]
                n = xn[i][:, None]
                may = (xc[i][:, None] == yc[yi]) & (xk[i][:, None] != yk[yi]) & (100 * n >= percent * yn[yi]) & (100 * yn[yi] >= percent * n)
                r, c = np.nonzero(may)
                if 4 * len(r) < may.size:  # few pairs: compare these alone
                    differ = np.concatenate([np.bitwise_count(a[lo + r[k : k + step * 8]] ^ b[c[k : k + step * 8]]).sum(1, dtype=np.int64) for k in range(0, len(r), step * 8)]) if len(r) else r
                else:
                    differ = np.bitwise_count(a[lo : lo + step, None, :] ^ b).sum(2, dtype=np.int64)[r, c]
                near = (100 + percent) * differ <= (100 - percent) * (xn[i[r]] + yn[yi[c]])
                rows.append(i[r[near]])
                columns.append(yi[c[near]])
    if not rows:
        return xk[:0], xk[:0]
    return forest(np.concatenate(rows), np.concatenate(columns), xk, yk)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches one by one; binary cells are views of the batch."""
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py() for c in b.columns)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _alone(compare):
    """Edges within each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _each(batches):
            a, r = compare(block, block)
            if len(a):
                yield _edges(a, r)

    return run


def _in_tiles(compare):
    """Edges between the blocks of a tile: those of side 0 come first and are held, those of side 1 pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for cluster, row, column, side, number, *block in _each(batches):
            if (cluster, row, column) != place:
                place, held = (cluster, row, column), []
            if side == 0:
                held.append((number, [bytes(x) for x in block]))
                continue
            for other, parts in held:
                a, r = compare(parts, block) if row != column or other < number else ((), ())
                if len(a):
                    yield _edges(a, r)

    return run


_TILE_BLOCKS = 16


def _dealt(blocks: DataFrame, columns: tuple[str, ...], compare) -> DataFrame:
    """Edges of tiles: rows (cluster, row, column, side, block, *columns), one block each."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["cluster", "row", "column"]
    tiles = blocks.select(*place, "side", "block", *columns).repartition(parts, *place).sortWithinPartitions(*place, "side", "block")
    return tiles.mapInArrow(_in_tiles(compare), "a long, b long")


def _all_pairs(blocks: DataFrame, columns: tuple[str, ...], compare, percent: int) -> DataFrame:
    """Edges between every two blocks of a cluster whose sizes let sets link.

    A cluster's blocks, in the order of their sizes, form stripes of ``_TILE_BLOCKS``. Every two
    stripes with sizes that may link, but not all in one component, meet in one task, which holds
    the blocks of one and reads those of the other one at a time. Which stripes a block goes to
    follows from numbers alone; the blocks' contents are shuffled once.
    """
    ranges = ("lo", "hi", "least", "most")
    light = blocks.select("cluster", "block", *((F.col(c) if c in blocks.columns else F.lit(i).cast("long").alias(c)) for i, c in enumerate(ranges)))
    each = Window.partitionBy("cluster")
    numbered = light.withColumn("k", F.count("*").over(each)).where("k > 1").withColumn("stripe", F.floor((F.row_number().over(each.orderBy("least", "block")) - 1) / _TILE_BLOCKS))
    stripes = numbered.groupBy("cluster", "stripe").agg(*(f(c).alias(c) for f, c in zip((F.min, F.max, F.min, F.max), ranges, strict=True)))
    x, y = (stripes.select("cluster", *(F.col(c).alias(f"{side}_{c}") for c in ("stripe", *ranges))) for side in "xy")
    met = x.join(y, "cluster").where("x_stripe <= y_stripe AND NOT (x_lo = x_hi AND y_lo = y_hi AND x_lo = y_lo)").where(f"100 * x_most >= {percent} * y_least AND 100 * y_most >= {percent} * x_least")
    at = lambda side: F.struct(F.col("x_stripe").alias("row"), F.col("y_stripe").alias("column"), F.lit(side).alias("side"))
    goes = met.select("cluster", F.explode(F.array(F.struct(F.col("x_stripe").alias("stripe"), at(0).alias("at")), F.struct(F.col("y_stripe").alias("stripe"), at(1).alias("at")))).alias("g")).select("cluster", "g.stripe", "g.at")
    targets = durable(numbered.select("cluster", "block", "stripe").join(goes, ["cluster", "stripe"]).groupBy("cluster", "block").agg(F.collect_list("at").alias("ats")))
    sent = blocks.select("cluster", "block", *columns).join(_bounded(targets), ["cluster", "block"])
    return _dealt(sent.withColumn("at", F.explode("ats")).select("cluster", "at.*", "block", *columns), columns, compare)


def _with_first(blocks: DataFrame, columns: tuple[str, ...], compare) -> DataFrame:
    """Edges between the first block of each cluster and its others."""
    crowd = blocks.groupBy("cluster").agg(F.count("*").alias("k"), F.min("block").alias("first")).where("k > 1").select("cluster", "first", F.ceil(F.col("k") / _TILE_BLOCKS).alias("stripes"))
    known = blocks.join(crowd, "cluster")
    leads = F.col("block") == F.col("first")
    stripe = F.when(leads, F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1)).otherwise(F.array(F.pmod(F.xxhash64("block"), F.col("stripes"))))
    met = known.select("cluster", F.explode(stripe).alias("row"), F.lit(-1).cast("long").alias("column"), F.when(leads, 0).otherwise(1).alias("side"), "block", *columns)
    return _dealt(met, columns, compare)


def _ordered(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (cluster, bucket, n, set_key, ..) dealt and sorted for packing: whole small clusters, large ones by size."""
    key = ["cluster", F.when(F.col("bucket") > 0, F.col("n")), F.when(F.col("bucket") > 0, F.col("set_key"))]
    return rows.repartitionByRange(parts, *key).sortWithinPartitions("cluster", key[1], "set_key")


def _refined(clusters: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Clusters cut to the sets that sizes and sketches still connect; no linked pair is parted."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = clusters.join(classes, "set_key")
    crowd = known.groupBy("cluster").agg(F.greatest(F.count("*") / _SKETCH_SETS, F.sum(F.length("sketch")) / _SKETCH_BYTES).alias("blocks"))
    rows = known.join(crowd, "cluster").select("cluster", (F.col("blocks") > 1).cast("long").alias("bucket"), "set_key", "n", "sketch")
    blocks = durable(_ordered(rows, parts).mapInArrow(_pack_sketches(_SKETCH_SETS, _SKETCH_BYTES), _SKETCHES), wide=True)
    columns = ("keys", "clusters", "sizes", "sketches")

    def alike(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
        return _alike(x, y, percent)

    within = blocks.select(*columns).mapInArrow(_alone(alike), "a long, b long")
    return _with_roots(connected_components(within.unionAll(_all_pairs(blocks, columns, alike, percent))))


def _with_roots(roots: DataFrame) -> DataFrame:
    """(set_key, cluster) of all nodes, roots among them."""
    clusters = roots.select(F.col("node").alias("set_key"), F.col("root").alias("cluster"))
    return clusters.unionAll(clusters.select(F.col("cluster").alias("set_key"), "cluster").distinct())


def _unpacked(keys: bytes, roots: bytes, clusters: bytes, sizes: bytes, shingles: bytes) -> tuple:
    size = np.frombuffer(sizes, np.int64)
    return np.frombuffer(keys, np.int64), np.frombuffer(roots, np.int64), np.frombuffer(clusters, np.int64), size, np.split(np.frombuffer(shingles, np.int64), np.cumsum(size)[:-1])


def _linked(x: tuple, y: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links between sets of two blocks, of one cluster but different components."""
    may = (x[2][:, None] == y[2][None, :]) & (x[1][:, None] != y[1][None, :])
    may &= (100 * x[3][:, None] >= percent * y[3][None, :]) & (100 * y[3][None, :] >= percent * x[3][:, None])
    i, j = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    if len(i) == 0:
        return x[0][:0], x[0][:0]
    both = _intersections([x[4][k] for k in i], [y[4][k] for k in j])
    sizes = x[3][i][:, None] + y[3][j][None, :]
    r, c = np.nonzero(may[np.ix_(i, j)] & ((100 + percent) * both >= percent * sizes))
    return forest(r, c, x[0][i], y[0][j])


def _rows_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _each(batches):
        keys, _, clusters, size, _ = _unpacked(*row)
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(row[4], np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(clusters), pa.array(keys), sets], ["cluster", "set_key", "shingles"])


_PARTS = ("keys", "roots", "clusters", "sizes", "shingles")


def _cluster_links(base: DataFrame, lists: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges that connect all linked classes."""
    spark = base.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stars = lists.join(lists.groupBy("list_key").agg(F.min("set_key").alias("b")), "list_key").select(F.col("set_key").alias("a"), "b")
    clusters = durable(_refined(_with_roots(connected_components(stars)), classes, percent))
    known = clusters.join(classes, "set_key")
    crowd = known.groupBy("cluster").agg(F.greatest(F.count("*") / _BLOCK_SETS, F.sum("n") / _BLOCK_SHINGLES).alias("blocks"))
    placed = durable(known.join(crowd, "cluster").select("set_key", "cluster", (F.col("blocks") > 1).cast("long").alias("bucket"), "n", F.col("first_id").alias("doc_id")))
    texts = base.join(_bounded(placed.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text")
    sets = texts.mapInArrow(_set_rows(width), "set_key long, shingles array<long>")
    packing = ("cluster", "bucket", "root", "set_key", "shingles")
    rows = sets.join(_bounded(placed.select("set_key", "cluster", "bucket", "n")), "set_key").withColumn("root", F.col("set_key"))
    blocks = durable(_ordered(rows, parts).select(*packing).mapInArrow(_pack_blocks(_BLOCK_SETS, _BLOCK_SHINGLES), _BLOCK), wide=True)

    def linked(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
        return _linked(_unpacked(*x), _unpacked(*y), percent)

    # Within blocks, then all blocks of a cluster with the first one, then what is still apart.
    links = durable(blocks.select(*_PARTS).mapInArrow(_alone(linked), "a long, b long").unionAll(_with_first(blocks, _PARTS, linked)))
    roots = connected_components(links).withColumnRenamed("node", "set_key")
    near = placed.where("bucket > 0").join(roots, "set_key", "left").select("set_key", "cluster", F.coalesce("root", "set_key").alias("root"))
    apart = near.groupBy("cluster").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cluster")
    moved = durable(near.join(apart, "cluster", "left_semi").select("set_key", "root"))
    again = blocks.join(apart, "cluster", "left_semi").select(*_PARTS).mapInArrow(_rows_of_blocks, "cluster long, set_key long, shingles array<long>")
    left = again.join(_bounded(moved), "set_key").withColumn("bucket", F.lit(1).cast("long")).withColumn("n", F.size("shingles"))
    packed = durable(_ordered(left, parts).select(*packing).mapInArrow(_pack_blocks(_BLOCK_SETS, _BLOCK_SHINGLES), _BLOCK), wide=True)
    # A block of one root has nothing to find within; blocks of several have.
    mixed = packed.where("lo < hi").select(*_PARTS).mapInArrow(_alone(linked), "a long, b long")
    return links.unionAll(durable(mixed.unionAll(_all_pairs(packed, _PARTS, linked, percent))))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles (set size) and component_id (smallest id reachable by links) of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = durable(base.mapInArrow(_describe(width), "doc_id long, n_shingles long, set_key long, sketch binary"))
    member = described.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = durable(member.groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    sizes = {int(r["n"]): int(r["k"]) for r in classes.where("n <= 32").groupBy("n").agg(F.count("*").alias("k")).collect()}  # 32 rows at most
    boundary = choose_boundary(sizes, percent)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = base.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_list_entries(width, percent, boundary), "list_key long, set_key long")
    lists = durable(listed.repartition(parts, "list_key").sortWithinPartitions("list_key", "set_key").mapInArrow(_shared_only, "list_key long, set_key long"))
    roots = connected_components(_cluster_links(base, lists, classes, width, percent))

    named = classes.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", "first_id", F.coalesce("root", "set_key").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_set = named.join(smallest, "root").select("set_key", "component_id")
    inside = member.join(by_set, "set_key").select("doc_id", "n_shingles", "component_id")
    outside = described.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return inside.unionAll(outside)
