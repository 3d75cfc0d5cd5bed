"""Fill-in-the-middle transformation of documents by a table-driven byte automaton.

One table serves three questions at every byte: whether a UTF-8 character goes on, whether a unit
(a line with its newline, or a character) opens, and how much of a sentinel has been read. It is
built from the sentinels: states are the start of a unit, the inside, the sentinels' proper
prefixes, and one to three bytes due of a character; classes are the bytes that any state tells
apart. The first pass numbers each byte's transition (state and class) and counts a document's
transitions; the counts give its units, characters and sentinels. The second pass finds the bytes
where the drawn units open, and texts are cut there.

A state depends on no more than the last few bytes, so the pass runs over many stretches of a
chunk at a time, each begun a few bytes early. An end mark stands behind every document.

Prefix, middle and suffix are drawn by four 32-bit numbers h1 to h4 of sha256("seed:id"). The prefix
ends after the smaller of h1 and h2 modulo n + 1 units, the middle after the larger. A text is left
plain where it is empty, holds a sentinel, or h3 % 100 >= ``rate``; else suffix comes first (spm)
where h4 % 100 < ``spm``, and prefix first (psm) otherwise.

Nulls: a null text is an empty document; a null id is drawn as an empty one. Repeated ids and rows
are documents of their own (rows of one id and text get one result). An empty table gives an empty
result. Other columns are ignored. Texts of any length are cut whole: a task holds one document's
bytes and one number for each of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textkernel as tk
from marlstone.session import bound_batches

SENTINELS = ("<P>", "<S>", "<M>")
_SLICE = 1 << 20
_LANE = 256
_END = 0xFF  # a byte that UTF-8 never holds


class Automaton:
    """The transition table of a unit rule and a set of sentinels, and its two passes."""

    def __init__(self, unit: str = "line", sentinels: tuple[str, ...] = SENTINELS) -> None:
        if unit not in ("line", "character"):
            raise ValueError(f"unknown unit: {unit}")
        marks = [s.encode("ascii") for s in sentinels]
        prefixes = sorted({m[:k] for m in marks for k in range(1, len(m))})
        if any(not m or b"\n" in m for m in marks) or any(m[k:] in {x[:j] for x in marks for j in range(1, len(x) + 1)} for m in marks for k in range(1, len(m))):
            raise ValueError("sentinels must be filled, on one line, and none may begin as another ends")
        # Classes: every byte of a sentinel by itself, then newline, other ASCII, continuation, leads of 2, 3 and 4, the end mark.
        alphabet = sorted({b for m in marks for b in m})
        newline, other, more, lead, end = len(alphabet), len(alphabet) + 1, len(alphabet) + 2, len(alphabet) + 3, len(alphabet) + 6
        self.classes = np.full(256, other, np.uint8)
        self.classes[0x80:0xC0] = more
        self.classes[0xC0:0xE0], self.classes[0xE0:0xF0], self.classes[0xF0:0xF8] = lead, lead + 1, lead + 2
        self.classes[0xF8:] = end
        self.classes[0x0A] = newline
        for c, b in enumerate(alphabet):
            self.classes[b] = c
        start, inside = 0, 1
        state = {p: 2 + i for i, p in enumerate(prefixes)}
        due = 1 + len(prefixes)  # due + k: k more bytes of a character
        n_states, self.width = due + 4, end + 1
        after = np.full((n_states, self.width), inside, np.uint16)
        opens, leads, ends = (np.zeros((n_states, self.width), bool) for _ in range(3))
        read = {start: b"", inside: b""} | {i: p for p, i in state.items()}
        for s in range(n_states):
            for c, b in enumerate(alphabet):
                tail = read.get(s, b"") + bytes([b])
                ends[s, c] = any(tail.endswith(m) for m in marks)
                after[s, c] = next((state[tail[k:]] for k in range(len(tail)) if tail[k:] in state), inside)
            after[s, newline] = after[s, end] = start
            after[s, lead], after[s, lead + 1], after[s, lead + 2] = due + 1, due + 2, due + 3
            if s > due + 1:
                after[s, more] = s - 1
        leads[:, [c for c in range(end) if c != more]] = True
        opens[:] = leads
        if unit == "line":
            opens[1:] = False
        self.after, self.opens, self.leads, self.ends = (t.ravel() for t in (after, opens, leads, ends))
        self.size, self.warm = after.size, max(4, *(len(m) for m in marks))

    def transitions(self, stream: np.ndarray) -> np.ndarray:
        """The number of each byte's transition."""
        out = np.empty(len(stream), np.uint16)
        for at in range(0, len(stream), _SLICE):
            out[at : at + _SLICE] = self._slice(stream, at, min(at + _SLICE, len(stream)))
        return out

    def _slice(self, stream: np.ndarray, at: int, to: int) -> np.ndarray:
        lanes = -(-(to - at) // _LANE)
        before = min(self.warm, at)
        bytes_ = np.full(self.warm + lanes * _LANE, _END, np.uint8)
        bytes_[self.warm - before : self.warm + to - at] = stream[at - before : to]
        cells = self.classes[bytes_]
        step = cells.strides[0]
        # Row j: the j-th byte of every lane, lanes beginning ``warm`` bytes early.
        steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(cells, (self.warm + _LANE, lanes), (step, _LANE * step)))
        codes = np.empty((_LANE, lanes), np.uint16)
        state = np.zeros(lanes, np.uint16)
        for j in range(self.warm + _LANE):
            code = state * np.uint16(self.width) + steps[j]
            state = self.after[code]
            if j >= self.warm:
                codes[j - self.warm] = code
        return codes.T.ravel()[: to - at]

    def counts(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each document took each transition; ``ends``: where documents end in the stream."""
        out = np.zeros((len(ends), self.size), np.int64)
        for at in range(0, len(codes), _SLICE):
            part = codes[at : at + _SLICE]
            first, last = (int(x) for x in np.searchsorted(ends, (at, at + len(part) - 1), "right"))
            edges = np.concatenate(([at], ends[first:last], [at + len(part)]))
            cells = np.repeat(np.arange(last - first + 1) * self.size, np.diff(edges)) + part
            out[first : last + 1] += np.bincount(cells, minlength=(last - first + 1) * self.size).reshape(-1, self.size)
        return out

    def openings(self, codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Where the units of the given running numbers open; the stream's length where there is none."""
        out = np.full(len(wanted), len(codes), np.int64)
        seen = 0
        for at in range(0, len(codes), _SLICE):
            here = np.flatnonzero(self.opens[codes[at : at + _SLICE]]) + at
            hit = (wanted >= seen) & (wanted < seen + len(here))
            out[hit] = here[wanted[hit] - seen]
            seen += len(here)
        return out


def _draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _transformed(table: Automaton, ids: list, raw: np.ndarray, rows: np.ndarray, seed: int, rate: int, spm: int, sentinels: tuple[str, ...]) -> pa.RecordBatch:
    """The rows of one chunk of documents."""
    n_docs = len(ids)
    stream = np.full(len(raw) + n_docs, _END, np.uint8)
    begins = rows[:-1] + np.arange(n_docs)
    ends = rows[1:] + np.arange(n_docs)  # the place of the end mark
    for r in range(n_docs):
        stream[begins[r] : ends[r]] = raw[rows[r] : rows[r + 1]]
    codes = table.transitions(stream)
    counts = table.counts(codes, ends + 1)
    units, marks = counts[:, table.opens].sum(1), counts[:, table.ends].sum(1)
    draws = [_draws(seed, i) for i in ids]
    cuts = np.array([sorted((h[0] % (n + 1), h[1] % (n + 1))) for h, n in zip(draws, units.tolist(), strict=True)], np.int64).reshape(-1, 2)
    numbers = cuts + (np.cumsum(units) - units)[:, None]
    places = np.where(cuts < units[:, None], table.openings(codes, numbers.ravel()).reshape(-1, 2), ends[:, None])
    p, s, m = (x.encode() for x in sentinels)
    leads = table.leads
    forms, heads, middles, outputs = [], [], [], []
    for r in range(n_docs):
        a, b, (x, y) = int(begins[r]), int(ends[r]), places[r].tolist()
        if a == b or marks[r] or draws[r][2] % 100 >= rate:
            forms.append("plain")
            heads.append(None)
            middles.append(None)
            outputs.append(stream[a:b].tobytes())
            continue
        prefix, middle, suffix = (stream[i:j].tobytes() for i, j in ((a, x), (x, y), (y, b)))
        heads.append(int(np.count_nonzero(leads[codes[a:x]])))
        middles.append(int(np.count_nonzero(leads[codes[x:y]])))
        if draws[r][3] % 100 < spm:
            forms.append("spm")
            outputs.append(b"".join((s, suffix, p, prefix, m, middle)))
        else:
            forms.append("psm")
            outputs.append(b"".join((p, prefix, s, suffix, m, middle)))
    columns = [pa.array(ids, pa.int64()), pa.array(units), pa.array(forms, pa.string()), pa.array(heads, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output of every document.

    unit: "line" or "character". rate: percent of documents to cut; spm: percent of those with the
    suffix first. sentinels: what stands before prefix, suffix and middle, in ASCII.
    """
    Automaton(unit, sentinels)  # wrong arguments fail here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Automaton(unit, sentinels)
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, to, raw, rows in tk.chunks(b.column(1)):
                for first in range(at, to, 4096):  # so many rows of counts at a time
                    last = min(to, first + 4096)
                    own = rows[first - at : last - at + 1]
                    yield _transformed(table, ids[first:last], raw[own[0] : own[-1]], own - own[0], seed, rate, spm, sentinels)

    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of. A text that was cut held no sentinel, so the three that stand there are the cuts."""
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), 4)
    first, second, middle = parts.getItem(1), parts.getItem(2), parts.getItem(3)
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
