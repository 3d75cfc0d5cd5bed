"""A SPARQL subset on a table of triples (s, p, o, is_uri).

A query string is parsed on the driver to a small plan; patterns become equi-joins of filtered
triples on their shared variables, which Catalyst orders and pushes down. Supported: SELECT, ASK,
CONSTRUCT, DESCRIBE, PREFIX, ``a``, ``;`` and ``,`` lists, OPTIONAL, FILTER with regex, contains,
=, != and &&, ORDER BY with ASC and DESC, DISTINCT, LIMIT and OFFSET. ``compat`` gives the lenient
readings: regex as a case-insensitive substring, = without regard to case, OPTIONAL as required,
LIMIT 0 as no limit, and CONSTRUCT without a template.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T

# The prefixes that are always known.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "okf": "urn:okf:ontology#",
    "concept": "urn:okf:concept:",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}
_TOKEN = re.compile(r"""<[^>\s]*>|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^\S+)?|'(?:[^'\\]|\\.)*'|\?\w+|\$\w+|&&|\|\||!=|>=|<=|[{}().;,=<>!*]|[\w-]*:[\w./#-]*[\w/#-]|[\w-]+:|[\w-]+""")


def uri_of(path: Column) -> Column:
    """The URI of a concept by its path or id."""
    return F.concat(F.lit(PREFIXES["concept"]), F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.md$", ""), r"^[./]+", ""), "/", "_"))


def triples(concepts: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Triples of concepts (id, path, title, type, trust_tier, status, description, tags) and edges (src, dst, kind)."""
    okf, uri = PREFIXES["okf"], uri_of(F.coalesce("path", "id"))
    one = lambda p, o, is_uri=False: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(is_uri).alias("is_uri"))
    fixed = [
        one(PREFIXES["rdf"] + "type", F.lit(okf + "Concept"), True),
        one(PREFIXES["dc"] + "title", F.coalesce("title", F.col("id"))),
        one(okf + "conceptType", F.coalesce("type", F.lit("concept"))),
        one(okf + "trustTier", F.col("trust_tier")),
        one(okf + "status", F.coalesce("status", F.lit("stable"))),
        one(PREFIXES["dc"] + "description", F.nullif(F.col("description"), F.lit(""))),
        one(okf + "filePath", F.col("path")),
    ]
    tags = F.transform(F.coalesce("tags", F.expr("cast(array() as array<string>)")), lambda t: one(okf + "tag", t))
    of_concepts = concepts.select(uri.alias("s"), F.explode(F.filter(F.concat(F.array(*fixed), tags), lambda x: x["o"].isNotNull())).alias("x")).select("s", "x.p", "x.o", "x.is_uri")
    if edges is None:
        return of_concepts
    predicate = F.when(F.col("kind").isin("depends_on", "prerequisite_of"), okf + "dependsOn").otherwise(okf + "relatedTo")
    return of_concepts.unionAll(edges.select(uri_of(F.col("src")).alias("s"), predicate.alias("p"), uri_of(F.col("dst")).alias("o"), F.lit(True).alias("is_uri")))


def expand_prefix(term: str, prefixes: dict[str, str]) -> str:
    if term == "a":
        return PREFIXES["rdf"] + "type"
    if term.startswith("<"):
        return term[1:-1]
    head, colon, rest = term.partition(":")
    return prefixes[head] + rest if colon and head in prefixes else term


def compact_uri(uri: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """The shortest form of a URI by the first prefix that fits."""
    out = None
    for name, full in prefixes.items():
        short = F.concat(F.lit(f"{name}:"), F.substring(uri, len(full) + 1, 1 << 20))
        out = F.when(uri.startswith(full), short) if out is None else out.when(uri.startswith(full), short)
    return uri if out is None else out.otherwise(uri)


@dataclass
class Group:
    patterns: list[tuple[str, str, str]] = field(default_factory=list)
    filters: list[list[str]] = field(default_factory=list)
    optional: list[Group] = field(default_factory=list)


@dataclass
class Query:
    kind: str = "SELECT"
    prefixes: dict[str, str] = field(default_factory=lambda: dict(PREFIXES))
    variables: list[str] = field(default_factory=list)
    distinct: bool = False
    where: Group = field(default_factory=Group)
    template: list[tuple[str, str, str]] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    describe: str | None = None


class _Reader:
    def __init__(self, text: str) -> None:
        self.tokens = _TOKEN.findall(re.sub(r"(?m)(^|\s)#[^\n]*$", r"\1", text))
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ""

    def is_word(self, *words: str) -> bool:
        return self.peek().upper() in words


def _term(token: str) -> str:
    """Variables keep their mark; literals get a quote in front; others are URIs or prefixed names."""
    if token[:1] in "?$":
        return "?" + token[1:]
    if token[:1] in "\"'":
        return '"' + token[1 : token.rindex(token[0])]
    return token


def _statements(r: _Reader, prefixes: dict[str, str]) -> Group:
    """What stands between braces."""
    g = Group()
    r.take()
    subject = predicate = ""
    while r.peek() not in ("}", ""):
        if r.is_word("OPTIONAL"):
            r.take()
            g.optional.append(_statements(r, prefixes))
        elif r.is_word("FILTER"):
            r.take()
            depth, found = 0, []
            while True:
                t = r.take()
                depth += (t == "(") - (t == ")")
                found.append(t)
                if not t or (depth == 0 and t == ")"):
                    break
            g.filters.append(found)
        elif r.peek() == ".":
            r.take()
            subject = predicate = ""
        elif r.peek() == ";":
            r.take()
            predicate = ""
        elif r.peek() == ",":
            r.take()
        elif not subject:
            subject = _term(r.take())
        elif not predicate:
            predicate = _term(r.take())
        else:
            g.patterns.append(tuple(t if t[0] in '?"' else expand_prefix(t, prefixes) for t in (subject, predicate, _term(r.take()))))
    r.take()
    return g


def parse(text: str) -> Query:
    """The plan of a query string; unknown words outside braces are passed over."""
    r, q = _Reader(text), Query()
    while r.peek():
        if r.is_word("PREFIX"):
            r.take()
            name, uri = r.take(), r.take()
            q.prefixes[name.rstrip(":")] = uri[1:-1]
        elif r.is_word("SELECT", "ASK", "CONSTRUCT", "DESCRIBE"):
            q.kind = r.take().upper()
            if q.kind == "CONSTRUCT" and r.peek() == "{":
                q.template = _statements(r, q.prefixes).patterns
            elif q.kind == "DESCRIBE":
                q.describe = expand_prefix(r.take(), q.prefixes)
            while q.kind == "SELECT" and (r.peek()[:1] in ("?", "$") or r.peek() == "*" or r.is_word("DISTINCT")):
                t = r.take()
                if t.upper() == "DISTINCT":
                    q.distinct = True
                else:
                    q.variables.append(t.lstrip("?$"))
        elif r.peek() == "{":
            q.where = _statements(r, q.prefixes)
        elif r.is_word("ORDER"):
            r.take(), r.take()
            while r.peek()[:1] in ("?", "$") or r.is_word("ASC", "DESC"):
                down = r.is_word("DESC")
                if r.is_word("ASC", "DESC"):
                    r.take(), r.take()
                    q.order.append((r.take().lstrip("?$"), down))
                    r.take()
                else:
                    q.order.append((r.take().lstrip("?$"), False))
        elif r.is_word("LIMIT"):
            r.take()
            q.limit = int(r.take())
        elif r.is_word("OFFSET"):
            r.take()
            q.offset = int(r.take())
        else:
            r.take()
    return q


def _matched(store: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    """Bindings of one pattern: a column for each variable, equal ones unified."""
    df, seen = store, {}
    for c, term in zip(("s", "p", "o"), pattern, strict=True):
        if term.startswith("?"):
            if term in seen:
                df = df.where(F.col(c) == F.col(seen[term]))
            else:
                seen[term] = c
        elif term.startswith('"'):
            df = df.where((F.col(c) == term[1:]) & ~F.col("is_uri"))
        else:
            df = df.where(F.col(c) == term)
    return df.select(*(F.col(c).alias(v[1:]) for v, c in seen.items())) if seen else df.select(F.lit(1).alias("_")).limit(1)


def _joined(left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
    if left is None:
        return right
    on = [c for c in left.columns if c in right.columns]
    return left.join(right, on, how) if on else left.join(right, how=how)


def _ordered(patterns: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Most constants first, then whatever shares a variable, so that no step is a product if one can be avoided."""
    left = sorted(patterns, key=lambda p: sum(t.startswith("?") for t in p))
    out, known = [], set()
    while left:
        nxt = next((p for p in left if known & {t for t in p if t.startswith("?")}), left[0])
        left.remove(nxt)
        out.append(nxt)
        known |= {t for t in nxt if t.startswith("?")}
    return out


def _condition(tokens: list[str], compat: bool) -> Column:
    text = [t for t in tokens]
    parts, now = [], []
    for t in text[1:-1]:
        if t == "&&":
            parts.append(now)
            now = []
        else:
            now.append(t)
    parts.append(now)
    out = F.lit(True)
    for p in parts:
        words = [t for t in p if t not in ("(", ")", ",")]
        if not words:
            continue
        name = words[0].lower()
        variables = [t for t in words if t[:1] in "?$"]
        literals = [_term(t)[1:] if t[:1] in "\"'" else t for t in words if t[:1] not in "?$" and t.lower() not in ("regex", "contains", "lcase", "str", "=", "!=")]
        known = name in ("regex", "contains") or "=" in words or "!=" in words
        if not known or len(variables) != 1 or not literals or any(t in ("||", "<", ">", "<=", ">=", "!") for t in words):
            if compat:
                continue
            raise ValueError(f"this FILTER is not known: {' '.join(p)}")
        v, value = F.col(variables[0][1:]), literals[0]
        if name == "regex":
            flags = "(?i)" if len(literals) > 1 and "i" in literals[1] else ""
            out = out & (F.lower(v).contains(value.lower()) if compat else v.rlike(flags + value))
        elif name == "contains":
            out = out & F.lower(v).contains(value.lower())
        elif "!=" in words:
            out = out & (v != value)
        elif "=" in words:
            out = out & ((F.lower(v) == value.lower()) if compat else (v == value))
    return out


def _bindings(store: DataFrame, g: Group, prefixes: dict[str, str], compat: bool) -> DataFrame | None:
    df = None
    for p in _ordered(g.patterns):
        df = _joined(df, _matched(store, p))
    for o in g.optional:
        more = _bindings(store, o, prefixes, compat)
        if more is not None:
            df = _joined(df, more, "inner" if compat or df is None else "left")
    if df is not None:
        for f in g.filters:
            resolved = [f'"{expand_prefix(t, prefixes)}"' if ":" in t and t[:1] not in "\"'?" else t for t in f]
            df = df.where(_condition(resolved, compat))
    return df


def run(store: DataFrame, text: str, compat: bool = False) -> DataFrame:
    """SELECT: a column for each variable. ASK: one row (answer). CONSTRUCT and DESCRIBE: (s, p, o)."""
    spark = store.sparkSession
    q = parse(text)
    if q.kind == "DESCRIBE":
        return store.where((F.col("s") == q.describe) | (F.col("o") == q.describe)).select("s", "p", "o")
    found = _bindings(store, q.where, q.prefixes, compat)
    if found is None:
        found = spark.range(1).select(F.lit(1).alias("_"))
    if q.kind == "ASK":
        return found.limit(1).agg((F.count("*") > 0).alias("answer"))
    if q.kind == "SELECT":
        found = found.distinct() if q.distinct or compat else found
        if q.distinct and q.variables not in ([], ["*"]):
            found = found.select(*(F.col(v) if v in found.columns else F.lit(None).cast("string").alias(v) for v in dict.fromkeys([*q.variables, *(v for v, _ in q.order)]))).distinct()
    else:
        found = found.distinct()
    for_order = [(F.desc if down else F.asc)(F.coalesce(F.col(v), F.lit(""))) for v, down in q.order if v in found.columns]
    if for_order:
        found = found.orderBy(*for_order, *sorted(found.columns))
    if q.offset:
        found = found.offset(q.offset)
    if q.limit is not None and not (compat and q.limit == 0):
        found = found.limit(q.limit)
    if q.kind == "CONSTRUCT":
        template = q.template if q.template and not compat else q.where.patterns[:1]
        value = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t[1:] if t.startswith('"') else t)
        rows = F.array(*(F.struct(value(s).alias("s"), value(p).alias("p"), value(o).alias("o")) for s, p, o in template))
        return found.select(F.explode(rows).alias("x")).select("x.s", "x.p", "x.o").where("s IS NOT NULL AND o IS NOT NULL").distinct()
    wanted = [c for c in found.columns if c != "_"] if q.variables in ([], ["*"]) else q.variables
    return found.select(*(F.col(v) if v in found.columns else F.lit(None).cast("string").alias(v) for v in wanted))
