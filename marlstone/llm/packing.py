"""Packing of tokenised documents into sequences by Karmarkar-Karp multiway differencing.

Each document becomes its token ids and one end id. Whole windows are cut off long documents
as sequences of their own; what remains is cut in pieces of ``piece_tokens`` at most (documents may
be cut anywhere) and waits. When the waiting pieces nearly fill ``group_windows`` windows, they are
split over that many windows: every piece starts as a partial partition with one filled part, and
the two partial partitions with the widest spread are merged, largest parts against smallest, until
one partition with near-equal sums is left. It stands as it is. Where one of its windows exceeds the
capacity, the pieces are split over one window more.

A task packs the rows that it reads, in their order, so nothing is shuffled and the waiting
pieces of a task are bounded by one group. The last window of a task is split off at powers of two,
which need no padding.

Tokenising: pretokens are found in whole batches of code points (letters, digits, other marks,
white space, with one leading space), and only distinct ones that the task has not met before
are given to the tokenizer. Texts with characters outside Latin script, control characters, strings
of special tokens, or pretokens of over 64 characters (whose hashes could be made to meet) are given
to the tokenizer whole.

Nulls: a null text is an empty document (one end id); null and repeated ids are packed as any
other. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textkernel as tk
from marlstone.session import bound_batches

U64 = np.uint64
_CACHE_SLOTS = 1 << 20
_MOST_POOLED = 1 << 22
_LONGEST = 64
_LETTER, _DIGIT, _OTHER, _SPACE, _FOREIGN = 0, 1, 2, 3, 4
#: Suffixes that split off after an apostrophe (fixed values of the vocabulary's pattern).
_ONE, _TWO = "stmd", ("re", "ve", "ll")

_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """Class of each code point; those outside Latin script and common marks are foreign."""
    if not _classes:
        table = np.full(0x110000, _FOREIGN, np.uint8)
        for c in (*range(0x20, 0x7F), 0x09, 0x0A, 0x0D, *range(0xA1, 0x180), *range(0x2010, 0x2028), 0x20AC):
            kind = unicodedata.category(chr(c))
            table[c] = _SPACE if chr(c).isspace() else _LETTER if kind[0] == "L" else _DIGIT if kind[0] == "N" else _OTHER
        table[0xAD] = _FOREIGN
        _classes.append(table)
    return _classes[0]


class Tokenizer:
    """Batch tokenisation with the ids of a byte-level BPE file.

    Pretokens met before are looked up in a direct-mapped table of fixed size; a later pretoken
    takes the slot of an earlier one.
    """

    def __init__(self, path: str, end_id: int = 0) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as File

        self.whole = File.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.end_id = end_id
        # A byte-level token has one character for each byte.
        self.id_bytes = np.zeros(self.whole.get_vocab_size(), np.int64)
        for token, i in self.whole.get_vocab().items():
            self.id_bytes[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(_CACHE_SLOTS, U64)
        self.at = np.zeros(_CACHE_SLOTS, np.int32)
        self.size = np.zeros(_CACHE_SLOTS, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]

    def _pretoken_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pretokens, flat, and how many each has.

        Pretokens of a space and letters stay apart when put behind one another, so they are
        tokenised as one text; the tokens' bytes tell where each ends.
        """
        chained = np.array([t[0] == " " and len(t) > 1 and _class_table()[ord(t[1])] == _LETTER for t in texts], bool)
        size = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray] = []
        order = np.concatenate([np.flatnonzero(chained), np.flatnonzero(~chained)])
        if chained.any():
            some = [t for t, c in zip(texts, chained.tolist(), strict=True) if c]
            ids = np.array(self.whole.encode("".join(some), add_special_tokens=False).ids, np.uint32)
            ends = np.cumsum([len(t.encode()) for t in some])
            last = np.searchsorted(np.cumsum(self.id_bytes[ids]), ends)
            size[chained] = np.diff(last + 1, prepend=0)
            parts.append(ids)
        if not chained.all():
            each = self._ids([t for t, c in zip(texts, chained.tolist(), strict=True) if not c])
            size[~chained] = [len(x) for x in each]
            parts.append(np.array([i for x in each for i in x], np.uint32))
        flat = np.concatenate(parts)
        at = np.zeros(len(texts), np.int64)
        at[order] = np.concatenate(([0], np.cumsum(size[order])[:-1]))
        return flat, np.stack([at, size])

    def _learn(self, keys: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, (at, size) = self._pretoken_ids(texts)
        if self.used + len(flat) > _MOST_POOLED:
            self._clear()
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(flat), self.used) + (1 << 16), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = at + self.used
        self.used += len(flat)
        slot = (keys & U64(_CACHE_SLOTS - 1)).astype(np.int64)
        self.keys[slot], self.at[slot], self.size[slot] = keys, at, size
        return at, size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        kind = _class_table()[points]
        foreign = np.flatnonzero(kind == _FOREIGN)
        odd = np.unique(np.searchsorted(rows, foreign, "right") - 1)
        start = self._starts(points, rows, kind)
        token_row = np.searchsorted(rows, start, "right") - 1
        end = np.append(start[1:], len(points))
        special = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        odd = np.unique(np.concatenate([odd, token_row[end - start > _LONGEST], np.array(special, np.int64)]))
        if len(odd):
            keep = ~np.isin(token_row, odd)
            start, end, token_row = start[keep], end[keep], token_row[keep]
        keys = tk.span_hashes(points, start, end)
        slot = (keys & U64(_CACHE_SLOTS - 1)).astype(np.int64)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        new = np.flatnonzero((self.keys[slot] != keys) | (size == 0))
        pool = self.pool
        if len(new):
            distinct, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            raw = points.tobytes()
            fresh = [raw[4 * s : 4 * e].decode("utf-32-le", "surrogatepass") for s, e in zip(start[new[first]].tolist(), end[new[first]].tolist(), strict=True)]
            used, table = self.used, self.keys
            new_at, new_size = self._learn(distinct, fresh)
            if self.keys is not table:  # it was cleared: read what was known from the old pool
                pool = np.concatenate([pool[:used], self.pool[: self.used]])
                new_at = new_at + used
            else:
                pool = self.pool
            at[new], size[new] = new_at[back], new_size[back]
        total = np.concatenate(([0], np.cumsum(size)))
        flat = pool[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        bounds = total[np.searchsorted(token_row, np.arange(len(texts) + 1))].tolist()
        end_id = np.array([self.end_id], np.uint32)
        out = [np.concatenate((flat[bounds[r] : bounds[r + 1]], end_id)) for r in range(len(texts))]
        if len(odd):
            for r, ids in zip(odd.tolist(), self._ids([texts[i] for i in odd]), strict=True):
                out[r] = np.array([*ids, self.end_id], np.uint32)
        return out

    @staticmethod
    def _starts(points: np.ndarray, rows: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where pretokens begin."""
        n = len(points)
        if n == 0:
            return np.zeros(0, np.int64)
        row_start = np.zeros(n + 1, bool)
        row_start[rows] = True
        begins = row_start[:-1].copy()
        begins[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        # The last character of a white-space run before a word: a space joins the word, others stand alone.
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~row_start[1:-1]
        begins |= last
        joined = np.flatnonzero(last & (points == 0x20)) + 1
        begins[joined] = False
        # An apostrophe that opens a pretoken of its own and is followed by a known suffix.
        apostrophe = np.flatnonzero(begins & (points == 0x27))
        apostrophe = apostrophe[apostrophe + 1 < n]
        apostrophe = apostrophe[(kind[apostrophe + 1] == _LETTER) & ~row_start[apostrophe + 1]]
        if len(apostrophe):
            one = points[apostrophe + 1]
            two = np.where((apostrophe + 2 < n) & ~row_start[np.minimum(apostrophe + 2, n)], points[np.minimum(apostrophe + 2, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in _ONE])
            long = np.zeros(len(apostrophe), bool)
            for suffix in _TWO:
                long |= (one == ord(suffix[0])) & (two == ord(suffix[1]))
            for which, step in ((short, 2), (long & ~short, 3)):
                a = apostrophe[which]
                begins[a + 1] = False
                a = a[a + step < n]
                begins[a + step] = True
        return np.flatnonzero(begins)


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece, by multiway differencing; every sum is near the mean."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64)
    heap, sums, trees = [], {}, {}
    for i, s in enumerate(sizes):
        # Only the filled parts are kept, largest first; the other parts are empty.
        sums[i] = np.array([s], np.int64)
        trees[i] = [[i]]
        heap.append((-int(s), i))
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y, tx, ty = sums.pop(a), sums.pop(b), trees.pop(a), trees.pop(b)
        if len(x) + len(y) <= windows:
            s, t = np.concatenate([x, y]), tx + ty
        else:
            over = len(x) + len(y) - windows  # parts of y that must share a part of x: largest with smallest
            s = np.concatenate([x, y[: len(y) - over]])
            t = tx + ty[: len(y) - over]
            for j in range(over):
                at = len(x) - 1 - j
                src = len(y) - over + j
                s[at] += y[src]
                t[at] = t[at] + ty[src]
        order = np.argsort(-s, kind="stable")
        s, t = s[order], [t[i] for i in order]
        if len(s) == windows and s[-1] > 0:
            spread = int(s[0] - s[-1])
        else:
            spread = int(s[0])
        sums[fresh], trees[fresh] = s, t
        heapq.heappush(heap, (-spread, fresh))
        fresh += 1
    out = np.zeros(n, np.int64)
    for w, members in enumerate(trees[heap[0][1]]):
        out[members] = w
    return out


class _Packer:
    """Packs one task's documents; pieces leave as soon as their window is decided."""

    def __init__(self, first_sequence: int, capacity: int, group_windows: int, piece_tokens: int) -> None:
        self.next_sequence, self.capacity, self.piece = first_sequence, capacity, piece_tokens
        # A few tokens a window are left free for the spread of the partition.
        self.group = group_windows
        self.fill = group_windows * (capacity - capacity // 128)
        self.waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.waiting_tokens = 0
        self.rows: list[tuple] = []

    def _emit(self, sequence: int, offset: int, piece: tuple) -> None:
        doc, start, ids, total = piece
        self.rows.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, sequence, offset))

    def add(self, doc, ids: np.ndarray) -> None:
        total, at, cap = len(ids), 0, self.capacity
        while total - at >= cap:
            self._emit(self.next_sequence, 0, (doc, at, ids[at : at + cap], total))
            self.next_sequence += 1
            at += cap
        while at < total:
            size = min(self.piece, total - at, self.fill - self.waiting_tokens)
            self.waiting.append((doc, at, ids[at : at + size].copy(), total))
            self.waiting_tokens += size
            at += size
            if self.waiting_tokens == self.fill:
                self._place(self.waiting, self.group)
                self.waiting, self.waiting_tokens = [], 0

    def flush(self) -> None:
        """Place what waits; what does not fill the last window is split at powers of two."""
        pieces, cap = self.waiting, self.capacity
        self.waiting, tokens, self.waiting_tokens = [], self.waiting_tokens, 0
        windows = tokens // (cap - cap // 128)
        rest = tokens - windows * (cap - cap // 128)
        tail: list[tuple] = []
        while rest:
            doc, start, ids, total = pieces.pop()
            cut = max(0, len(ids) - rest)
            tail.append((doc, start + cut, ids[cut:], total))
            rest -= len(ids) - cut
            if cut:
                pieces.append((doc, start, ids[:cut], total))
        if pieces:
            self._place(pieces, windows)
        self._powers(tail[::-1])

    def _place(self, pieces: list[tuple], windows: int) -> None:
        """Split the pieces over ``windows``, or over as many more as keep each within the capacity."""
        sizes = np.array([len(p[2]) for p in pieces])
        while True:
            window = differencing(sizes, windows)
            if np.bincount(window, sizes, windows).max() <= self.capacity:
                break
            windows += 1
        held: list[list[tuple]] = [[] for _ in range(windows)]
        for p, w in zip(pieces, window.tolist(), strict=True):
            held[w].append(p)
        for h in held:
            offset = 0
            for p in h:
                self._emit(self.next_sequence, offset, p)
                offset += len(p[2])
            self.next_sequence += len(h) > 0

    def _powers(self, pieces: list[tuple]) -> None:
        left = sum(len(p[2]) for p in pieces)
        room, offset = 0, 0
        for doc, start, ids, total in pieces:
            while len(ids):
                if not room:
                    room, offset = 1 << (left.bit_length() - 1), 0
                    sequence, self.next_sequence = self.next_sequence, self.next_sequence + 1
                cut = min(room, len(ids))
                self._emit(sequence, offset, (doc, start, ids[:cut], total))
                start, ids = start + cut, ids[cut:]
                room, offset, left = room - cut, offset + cut, left - cut

    def take(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, group_windows: int = 128, piece_tokens: int = 256, end_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer_path: a byte-level BPE file; None takes the installed ``byte_bpe_50k.json`` of
    each executor. A sequence id is the task's number in the upper bits and a running number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        tokenizer = Tokenizer(path, end_id)
        packer = _Packer(TaskContext.get().partitionId() << 36, capacity, group_windows, min(piece_tokens, capacity))
        for b in batches:
            ids = b.column(0).to_pylist()
            at, texts, size = 0, [], 0
            for i, x in enumerate(b.column(1)):
                texts.append(x.as_py() or "")
                size += len(texts[-1])
                if size >= 1 << 19 or i == b.num_rows - 1:
                    for doc, tokens in zip(ids[at : i + 1], tokenizer.encode(texts), strict=True):
                        packer.add(doc, tokens)
                    at, texts, size = i + 1, [], 0
            if len(packer.rows) >= 20_000:
                yield packer.take(_SCHEMA)
        packer.flush()
        yield packer.take(_SCHEMA)

    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
