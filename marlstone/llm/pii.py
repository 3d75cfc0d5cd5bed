"""Personal data by candidate gradient boosting, in DataFrame operations.

Generators of high recall propose spans, which may overlap: the rule-checked base patterns, and
wider forms (numbers without a country code, card-like digit groups, spelled-out addresses).
Wide candidates that meet a base span are left to it. Of the others, those with evidence of their
own are redacted: an address that ends in letters, eight groups of an IPv6 address, card digits
with a right check digit, a national number after a telling word. Boosted trees score the rest by
format and context: length, digits, separators, the characters around, and a telling word before.
They are fitted on weak labels, which are this evidence and, for numbers, a base address or number
in the same text. A threshold for each kind is calibrated on held-out candidates to a wanted
precision, and where a kind cannot reach it the trees add nothing. Base spans always stay.

All features have few values, so the fit sees at most ``_MOST_VECTORS`` distinct vectors with
counts, gathered by one grouped aggregation over all documents. The trees
are compiled to CASE expressions; a document is read once, in one narrow projection, without a
shuffle, and its spans follow from the lengths of what the pattern splits off.

Nulls: a null text is an empty one; null and repeated ids are rows of their own. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Base patterns, with possessive repeats and no start inside a run that was already refused.
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WIDE = {
    "email": r"[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?: ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Cheap tests that a text passes if its pattern can match.
_GUARD = {
    ("base", "email"): lambda t: t.contains("@"),
    ("base", "ip"): lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    ("base", "card"): lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    ("base", "phone"): lambda t: t.contains("+"),
    ("wide", "email"): lambda t: t.contains("at)") | t.contains("at]"),
    ("wide", "ip"): lambda t: t.contains(":") & t.rlike(r"(?:[0-9A-Fa-f]{1,4}:){7}"),
    ("wide", "card"): lambda t: t.rlike(r"[0-9](?:[\x20.-]?[0-9]){12}"),
    ("wide", "phone"): lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
}
#: Words that tell a telephone number, shortly before it.
_CALLS = r"(?i)\b(?:tel|telephone|phone|call|fax|mobile|cell|contact)\b[^0-9\n]{0,12}$"
_HINT = r"(?i)(mail|contact|tel|phone|call|fax|mobile|card|visa|pay|account|ip|host|addr)"
_BINS = {"kind": 4, "length": 6, "digits": 6, "separators": 5, "before": 4, "after": 4, "hint": 2}
_MOST_VECTORS = math.prod(_BINS.values())
_RUN = 64


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})?+(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})?+){3}$")
    n = F.length(_digits(m))
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", _digits(m))
    return n.between(10, 15)


def _evident(kind: str, c: Column) -> Column:
    """Whether a located wide candidate shows by itself, whatever the base rules find, that it is of its kind."""
    m = c["m"]
    if kind == "email":
        return m.rlike(r"[.\])] ?[A-Za-z]{2,}$")
    if kind == "ip":
        # Eight pairs may be a hardware address or a time.
        return m.rlike(r"[0-9A-Fa-f]{3}")
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    return _digits(m).rlike(r"^[2-9][0-9]{2}[2-9]") & c["before"].rlike(_CALLS)


def _matches(text: Column, pattern: str, guard: Column) -> tuple[Column, Column]:
    """The matches of a pattern and the pieces around them; null where the guard fails."""
    return F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.when(guard, F.split(text, pattern, -1))


def _located(found: Column, pieces: Column) -> Column:
    """The matches as structs of start, end, text, and the text before and after.

    A match starts where the pieces and matches before it end. Their lengths are summed over runs
    of ``_RUN`` matches, and within a run from its start, so that the work grows with the number
    of matches and not with its square.
    """
    length = lambda i: F.char_length(F.get(pieces, i)) + F.char_length(F.get(found, i))
    total = lambda lo, hi: F.aggregate(F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.expr("cast(array() as array<int>)")), F.lit(0), lambda acc, i: acc + length(i))

    def of_run(first: Column, begin: Column) -> Column:
        def one(i: Column) -> Column:
            start = begin + total(first, i) + F.char_length(F.get(pieces, i))
            m = F.get(found, i)
            return F.struct(start.alias("start"), (start + F.char_length(m)).alias("end"), m.alias("m"), F.right(F.get(pieces, i), F.lit(24)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(1)).alias("after"))

        return F.transform(F.sequence(first, F.least(first + _RUN, F.size(found)) - 1), one)

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _RUN).cast("int")), lambda k: F.struct((k * _RUN).alias("first"), total(k * _RUN, F.least((k + 1) * _RUN, F.size(found))).alias("size")))
    # Few runs: their starts are sums over the runs before.
    begun = F.transform(F.array(runs), lambda rs: F.transform(rs, lambda r, k: F.struct(r["first"].alias("first"), F.aggregate(F.slice(rs, F.lit(1), k), F.lit(0), lambda acc, x: acc + x["size"]).alias("begin"))))
    return F.when(F.size(found) > 0, F.flatten(F.transform(F.get(begun, F.lit(0)), lambda r: of_run(r["first"], r["begin"]))))


def _around(c: Column) -> Column:
    """0: nothing or space, 1: letter, 2: digit, 3: other."""
    return F.when((c == "") | c.isNull() | c.rlike(r"^\s"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike(r"^[0-9]"), 2).otherwise(3)


def _features(kind: int, c: Column) -> dict[str, Column]:
    m = c["m"]
    has = lambda x: m.contains(x)
    several = has(" ").cast("int") + has("-").cast("int") + has(".").cast("int")
    return {
        "kind": F.lit(kind),
        "length": F.least(F.lit(5), F.floor(F.char_length(m) / 4)).cast("int"),
        "digits": F.least(F.lit(5), F.floor(F.length(_digits(m)) / 3)).cast("int"),
        "separators": F.when(several > 1, 4).when(has(" "), 1).when(has("-"), 2).when(has("."), 3).otherwise(0),
        "before": _around(F.right(c["before"], F.lit(1))),
        "after": _around(c["after"]),
        "hint": c["before"].rlike(_HINT).cast("int"),
    }


@dataclass(frozen=True)
class Tree:
    """A leaf with a value, or a split: feature <= bound goes left."""

    value: float = 0.0
    feature: str = ""
    bound: int = 0
    left: Tree | None = None
    right: Tree | None = None

    def of(self, x: dict[str, int]) -> float:
        return self.value if self.left is None else (self.left if x[self.feature] <= self.bound else self.right).of(x)

    def column(self, x: Column) -> Column:
        if self.left is None:
            return F.lit(self.value)
        return F.when(x[self.feature] <= self.bound, self.left.column(x)).otherwise(self.right.column(x))


def _grow(rows: list[tuple[dict, float, float]], depth: int, least: float, shrink: float) -> Tree:
    """rows: feature vector, sum of gradients, sum of curvatures. Newton leaves, best gain splits."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = Tree(shrink * g / (h + 1.0))
    if depth == 0:
        return leaf
    best: tuple = (1e-6, "", 0)
    for f, n in _BINS.items():
        gs, hs = [0.0] * n, [0.0] * n
        for x, a, b in rows:
            gs[x[f]] += a
            hs[x[f]] += b
        gl = hl = 0.0
        for cut in range(n - 1):
            gl += gs[cut]
            hl += hs[cut]
            if hl >= least and h - hl >= least:
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, f, cut)
    if not best[1]:
        return leaf
    _, f, cut = best
    return Tree(0.0, f, cut, _grow([r for r in rows if r[0][f] <= cut], depth - 1, least, shrink), _grow([r for r in rows if r[0][f] > cut], depth - 1, least, shrink))


@dataclass(frozen=True)
class Model:
    """Boosted trees with the margin from which a candidate of a kind is redacted (None: never)."""

    bias: float
    trees: tuple[Tree, ...]
    margins: tuple[float | None, ...]

    def margin(self, x: dict[str, int]) -> float:
        return self.bias + sum(t.of(x) for t in self.trees)

    def column(self, x: Column) -> Column:
        total = F.lit(self.bias)
        for t in self.trees:
            total = total + t.column(x)
        return total


def fit_trees(vectors: list[dict], rounds: int = 25, depth: int = 3, shrink: float = 0.3, precision: float = 0.98, least: int = 30) -> Model:
    """Boost on distinct vectors with counts: n, right (of n), n_held, right_held."""
    n, right = sum(v["n"] for v in vectors), sum(v["right"] for v in vectors)
    if not n:
        return Model(0.0, (), (None,) * len(KINDS))
    share = min(max(right / n, 1e-4), 1 - 1e-4)
    bias = math.log(share / (1 - share))
    margins, trees = [bias] * len(vectors), []
    for _ in range(rounds if 0 < right < n else 0):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, m)))) for m in margins]
        rows = [(v, v["right"] - v["n"] * q, v["n"] * q * (1 - q)) for v, q in zip(vectors, p, strict=True)]
        t = _grow([r for r in rows if r[0]["n"]], depth, 1.0, shrink)
        trees.append(t)
        margins = [m + t.of(v) for m, v in zip(margins, vectors, strict=True)]
    bars: list[float | None] = []
    for kind in range(len(KINDS)):
        ranked = sorted(((m, v["n_held"], v["right_held"]) for m, v in zip(margins, vectors, strict=True) if v["kind"] == kind), reverse=True)
        bar, seen, good = None, 0, 0
        for i, (m, a, b) in enumerate(ranked):
            seen, good = seen + a, good + b
            tied = i + 1 < len(ranked) and ranked[i + 1][0] == m
            if not tied and seen >= least and good >= precision * seen:
                bar = m
        bars.append(bar)
    return Model(bias, tuple(trees), tuple(bars))


def _as_spans(located: Column, kind: int) -> Column:
    return F.transform(located, lambda c: F.struct(c["start"].alias("start"), F.lit(kind).alias("kind"), c["end"].alias("end")))


def _with_candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and, by kind, base_<kind> (valid spans) and wide_<kind> (located wide candidates) of each text."""
    df = docs
    text = F.col("__text")
    for source, patterns in (("base", _BASE), ("wide", _WIDE)):
        for k in KINDS:
            found, pieces = _matches(text, patterns[k], _GUARD[source, k](text))
            df = df.withColumns({f"m_{source}_{k}": found, f"p_{source}_{k}": pieces})
    df = df.withColumns({f"l_{s}_{k}": _located(F.col(f"m_{s}_{k}"), F.col(f"p_{s}_{k}")) for s in ("base", "wide") for k in KINDS})
    none = F.expr(f"cast(array() as {_SPAN})")

    def valid_spans(i: int, k: str) -> Column:
        return F.coalesce(_as_spans(F.filter(f"l_base_{k}", lambda c: _valid(k, c["m"])), i), none)

    spans = {f"base_{k}": valid_spans(i, k) for i, k in enumerate(KINDS)}
    return df.select(*keep, *(e.alias(n) for n, e in spans.items()), *(F.col(f"l_wide_{k}").alias(f"wide_{k}") for k in KINDS))


def _meets(c: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


def _meets_any(c: Column) -> Column:
    return reduce(or_, (_meets(c, F.col(f"base_{k}")) for k in KINDS))


def fit(docs: DataFrame) -> Model:
    """Fit on all documents: two of three by a hash of the id give the trees, the others the thresholds."""
    seen = _with_candidates(docs, ["__id"])
    held = F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(3)) == 0
    none = F.expr("cast(array() as array<struct<kind:int,length:int,digits:int,separators:int,before:int,after:int,hint:int,hit:boolean>>)")

    reached = F.size("base_email") + F.size("base_phone") > 0

    def vectors_of(i: int, k: str) -> Column:
        right = lambda c: (_evident(k, c) | reached) if k == "phone" else _evident(k, c)
        own = F.filter(f"wide_{k}", lambda c: ~_meets_any(c))
        one = F.transform(own, lambda c: F.struct(*(v.alias(n) for n, v in _features(i, c).items()), right(c).alias("hit")))
        return F.coalesce(one, none)

    rows = F.concat(*(vectors_of(i, k) for i, k in enumerate(KINDS)))
    flat = seen.select(held.alias("held"), F.explode(rows).alias("c"))
    counted = flat.groupBy(*(f"c.{n}" for n in _BINS)).agg(
        F.count_if(~F.col("held")).alias("n"), F.count_if(~F.col("held") & F.col("c.hit")).alias("right"), F.count_if("held").alias("n_held"), F.count_if(F.col("held") & F.col("c.hit")).alias("right_held")
    )
    vectors = sorted((r.asDict() for r in counted.collect()), key=lambda v: tuple(v[n] for n in _BINS))  # _MOST_VECTORS rows at most
    return fit_trees(vectors)


def find(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` and the columns base and spans: arrays of (start, kind, end), sorted, of each text."""
    seen = _with_candidates(docs, keep)
    none = F.expr(f"cast(array() as {_SPAN})")

    def accepted(i: int, k: str, bar: float | None) -> Column:
        def passes(c: Column) -> Column:
            own = ~_meets_any(c) & _evident(k, c)
            if bar is None or k == "card":  # digits with a wrong check digit are no card
                return own
            # The array of one binds the features, so that each tree reads them ready.
            bound = F.array(F.struct(*(v.alias(n) for n, v in _features(i, c).items())))
            return own | (~_meets_any(c) & F.exists(bound, lambda x: model.column(x) >= bar - 1e-9))

        return F.coalesce(_as_spans(F.filter(f"wide_{k}", passes), i), none)

    added = [accepted(i, k, model.margins[i]) for i, k in enumerate(KINDS)]
    with_base = seen.withColumn("base", F.array_sort(F.concat(*(F.col(f"base_{k}") for k in KINDS))))
    spans = F.array_sort(F.concat("base", *added))
    return with_base.select(*keep, "base", spans.alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _prepared(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"), *(extra or []))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans (all of them) of every document."""
    base = _prepared(docs)
    found = find(base, fit(base), ["__id"])
    counts = [_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(F.col("__id").alias("doc_id"), *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; n_chars follows where there is one."""
    base = _prepared(docs, [F.col(c).alias(f"__c_{i}") for i, c in enumerate(docs.columns)])
    kept = [f"__c_{i}" for i in range(len(docs.columns))]
    found = find(base, fit(base), [*kept, "__text"])
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        # A span that lies over the one before is redacted with it.
        clear = s["start"] >= acc["at"]
        put = F.concat(F.substring(F.col("__text"), acc["at"] + 1, s["start"] - acc["at"]), F.get(marks, s["kind"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(clear, F.concat(acc["out"], F.array(put))).otherwise(acc["out"]).alias("out"))

    joined = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("__text"), acc["at"] + 1, F.lit(2**31 - 1))))
    changed = found.withColumn("__new", F.when(F.size("spans") > 0, joined).otherwise(F.col("__text")))
    columns = []
    for i, c in enumerate(docs.columns):
        old = F.col(f"__c_{i}")
        if c == "text":
            old = F.when(F.size("spans") > 0, F.col("__new")).otherwise(old)
        elif c == "n_chars":
            old = F.when(F.size("spans") > 0, F.char_length("__new").cast("long")).otherwise(old)
        columns.append(old.alias(c))
    return changed.select(*columns)
