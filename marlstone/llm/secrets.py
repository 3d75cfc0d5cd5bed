"""Secret scan by sliding-window Shannon entropy per character class.

Rule-checked base patterns (assignments, access keys, long hexadecimal runs) are always kept.
Beside them, every candidate string (a long run of key-like characters that mixes letters and
digits) is scanned by a window. Counts of the window's characters are kept incrementally as it
slides, one set of counts for each class (lower case, upper case, digits, marks), and the
entropies of the classes follow from the counts. Allow-list rules suppress what they explain and
no more: identifiers in UUID form, dates and numbers, path segments, placeholder words (each takes
its own part out of the candidate), repeated or sequential characters, and candidates given by the
caller. What is left is a secret where one of its windows reaches the bar of the classes it mixes.

Scans whole texts, a row at a time, without a shuffle. Nulls: a null text is an empty one; null
and repeated ids are rows of their own. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import bound_batches

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGIT = re.compile("[0-9]")
#: Forms that are no secrets: identifiers, dates, and segments of words, also joined by capitals, with a short number.
_ALLOWED = [
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]+)?(?![0-9])"),
    re.compile(r"(?<![A-Za-z0-9])(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)[0-9]{0,4}(?![A-Za-z0-9])"),
    re.compile(r"(?<![A-Za-z0-9])[A-Za-z]?[a-z]+(?:[A-Z][a-z]{2,})+[0-9]{0,4}(?![A-Za-z0-9])"),
]
#: Words that mark a segment as an example.
_EXAMPLE = re.compile(r"example|sample|placeholder|dummy|changeme|xxxx|your", re.IGNORECASE)
WINDOW = 20
#: Bits of entropy that a window needs, by how many of lower, upper and digits it mixes.
_BARS = {2: 3.4, 3: 3.6}

_CLASS = {}
for _c in range(128):
    _s = chr(_c)
    _CLASS[_s] = 0 if _s.islower() else 1 if _s.isupper() else 2 if _s.isdigit() else 3
_PLOGP = [0.0] + [n * log2(n) for n in range(1, WINDOW + 1)]


def window_entropies(s: str, width: int = WINDOW) -> Iterator[tuple[int, float, list[float], list[int]]]:
    """(offset, entropy of all characters, entropy of each class, characters of each class) of each window."""
    counts: dict[str, int] = {}
    sums, sizes = [0.0] * 4, [0] * 4  # sum of n log n over the characters of a class; characters of it
    total = 0.0

    def add(c: str, d: int) -> None:
        nonlocal total
        n, k = counts.get(c, 0), _CLASS.get(c, 3)
        change = _PLOGP[n + d] - _PLOGP[n]
        counts[c] = n + d
        sums[k] += change
        total += change
        sizes[k] += d

    for i, c in enumerate(s):
        add(c, 1)
        if i >= width:
            add(s[i - width], -1)
        if i >= width - 1:
            yield i - width + 1, log2(width) - total / width, [log2(n) - x / n if n else 0.0 for x, n in zip(sums, sizes, strict=True)], list(sizes)


def _regular(s: str) -> bool:
    """Few distinct characters, or mostly steps of zero or one from character to character."""
    if len(set(s)) < 8:
        return True
    steps = sum(abs(ord(a) - ord(b)) <= 1 for a, b in zip(s, s[1:], strict=False))
    return 2 * steps > len(s)


def _unexplained(s: str) -> list[str]:
    """The parts of a candidate that no allow-list rule explains."""
    for p in _ALLOWED:
        s = p.sub("\n", s)
    return [x for x in s.split("\n") if len(x) >= WINDOW and not all(_EXAMPLE.search(y) or len(y) < 8 for y in re.split(r"[/_=+-]", x))]


def is_secret(s: str, allow: frozenset[str] = frozenset()) -> bool:
    if s in allow or not _DIGIT.search(s):
        return False
    for part in _unexplained(s):
        if _regular(part):
            continue
        for _, bits, by_class, sizes in window_entropies(part):
            mixed = sum(n > 0 for n in sizes[:3])
            # Letters of several values with digits or the other case among them: not a word with a number.
            if mixed >= 2 and sizes[2] and bits >= _BARS[mixed] and max(by_class[0], by_class[1]) >= 1.5:
                return True
    return False


def scan(text: str, allow: frozenset[str] = frozenset()) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text as (start, kind, end), sorted."""
    base: list[tuple[int, int, int]] = []
    if ("=" in text or ":" in text) and _ASSIGN_WORDS.search(text):
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base.sort()
    more, at, reach = [], 0, 0
    for m in _CANDIDATE.finditer(text):  # in the order of their starts, as the base spans are
        s, e = m.span()
        while at < len(base) and base[at][0] < e:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= s and is_secret(m[0], allow):
            more.append((s, 3, e))
    return base, sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_report(docs: DataFrame, allow: frozenset[str] = frozenset()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_entropy of every document."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(x.as_py() or "", allow) for x in b.column(1)]
            n = [[sum(k == kind for _, k, _ in every) for _, every in found] for kind in range(4)]
            digest = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
            counts = [pa.array(c, pa.int64()) for c in n]
            columns = [b.column(0), *counts[:3], pa.array(digest, pa.string()), pa.array([written(every) for _, every in found], pa.string()), counts[3]]
            yield pa.RecordBatch.from_arrays(columns, names)

    bound_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")
