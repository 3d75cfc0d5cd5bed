"""Fill-in-the-middle, lexical search and token files against plain Python and SQL."""

import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter

import compare
import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from marlstone.llm import fill_middle, lexical_search, queries, token_files

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", "\n", "\n\n", "a", "a\nb", "a\nb\n", "<P>", "x\n<S>y\n", "<M", "<P\n>", "<<P>", "<<M\n<S", "é\n😀😀\nß<\nP>\n", "a<P\nS>b\n", "\r\n\x0b\n", "ü" * 700 + "\n" + "😀" * 5000, "<" * 3000, "<P" * 1500 + "\n",
    "line\n" * 9000, "x" * 300_000 + "\n" + "y" * 300_000, "< P>\n<p>\n", "\x00\n\x7f",
]


def plain_fim(doc_id, text, rate=100, spm=50, unit="line", seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (doc_id, len(lines), "plain", None, None, text)
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(lines), "spm" if h4 % 100 < spm else "psm", len(p), len(m), out)


@pytest.mark.parametrize("unit,rate,spm", [("line", 100, 50), ("character", 60, 0), ("character", 100, 100)])
def test_fill_in_middle_equals_plain_rules(spark, unit, rate, spm):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab<PSM>\n\n é😀") for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a\nb\n", "x"), (5, "a\nb", "x"), (5, "a\nb", "x"), (5, "c\nd\ne", None)]
    made = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, output string"), unit=unit, rate=rate, spm=spm)
    got = made.withColumn("back", fill_middle.restored(made["output"], made["form"])).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(plain_fim(i, t, rate, spm, unit) for i, t, _ in rows)
    texts_by_id = Counter((i, t or "") for i, t, _ in rows)
    assert Counter((r["doc_id"], r["back"]) for r in got) == texts_by_id


def test_fill_in_middle_counts_transitions():
    table = fill_middle.Automaton()
    stream = np.frombuffer("é<P>\n<<M>x\n".encode() + b"\xff" + b"\xff" + b"\n\xff", np.uint8)
    codes = table.transitions(stream)
    counts = table.counts(codes, np.array([13, 14, 16]))
    assert counts.sum(1).tolist() == [13, 1, 2]
    assert counts[:, table.opens].sum(1).tolist() == [2, 0, 1]
    assert counts[:, table.ends].sum(1).tolist() == [2, 0, 0]
    assert counts[:, table.leads].sum(1).tolist() == [11, 0, 1]
    long = np.frombuffer(("ab<P>é\n" * 400_000).encode() + b"\xff", np.uint8)  # over more than one slice
    codes = table.transitions(long)
    assert table.ends[codes].sum() == 400_000 and table.opens[codes].sum() == 400_000
    assert table.openings(codes, np.array([0, 1, 399_999, 400_000])).tolist() == [0, 8, 8 * 399_999, len(long)]


def test_fill_in_middle_arguments(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.fill_in_middle(docs).collect() == []
    for sentinels in (("<P>", "<S>", ">M<"), ("", "b", "c"), ("<\nP>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(docs, sentinels=sentinels)
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, unit="page")
    one = fill_middle.fill_in_middle(spark.createDataFrame([(1, "a\nb\nc\n")], "doc_id long, text string"), sentinels=("[pre]", "[suf]", "[mid]")).first()
    assert {"[pre]", "[suf]", "[mid]"} <= set(re.findall(r"\[\w+\]", one["output"]))


TERM = re.compile(lexical_search.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k, b=50):
    terms = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n_docs, length = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, asked in wanted.items():
        found = []
        for i, c in terms:
            m = 100 - b + (b * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked & set(c))
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return Counter(out)


@pytest.mark.parametrize("block_terms", [500_000, 40])
def test_lexical_search_equals_brute_force(spark, block_terms):
    rng = random.Random(11)
    words = [f"w{n}" for n in range(300)] + ["the", "Ünde", "ÄB", "x9"]
    text = lambda n: rng.choice([" ", "-", "\n", "\x00"]).join(rng.choice(["the", rng.choice(words), words[min(303, int(rng.expovariate(0.03)))]]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 120))) for i in range(900)]
    docs += [(None, "the w1 w2"), (None, "w1"), (7, "w1 W1 w2"), (7, "w1 W1 w2"), (2000, None), (2001, ""), (2002, "- _ ."), (2003, "the " * 50_000 + "rare1")] + [(3000 + n, "copy of the passage w5 w6") for n in range(300)]
    items = [(i, text(rng.randrange(1, 30))) for i in range(20)] + [(30, None), (31, ""), (None, "w1"), (32, "the"), (33, "nowhere9"), (34, "rare1"), (35, "W5 passage"), (36, "w1"), (36, "w2 the"), (36, "w1"), (37, "!?")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, rank int").repartition(7)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id long")
    got = Counter(map(tuple, lexical_search.ranked_search(df, asked, k=10, block_terms=block_terms).collect()))
    assert got == plain_search(docs, items, 10)


def test_lexical_search_prunes_safely():
    """Pruned terms stay below the threshold together, and one more would not."""
    rng = np.random.default_rng(5)
    items = lexical_search._Items([f"t{n}".encode() for n in range(50)], list(range(40)), np.arange(41) * 8, np.concatenate([rng.choice(50, 8, replace=False) for _ in range(40)]))
    most = rng.integers(1, 1000, 50)
    kth = (most * rng.random(50)).astype(np.int64)
    plan = lexical_search.pruned_plan(items, kth, most)
    cut = 0
    for i in range(40):
        terms = set(items.term[8 * i : 8 * i + 8].tolist())
        out = plan.pruned[plan.pruned_first[i] : plan.pruned_first[i + 1]].tolist()
        seeds = [t for t in range(50) if i in plan.item[plan.first[t] : plan.first[t + 1]]]
        assert plan.threshold[i] == max(kth[t] for t in terms) and set(out) | set(seeds) == terms and not set(out) & set(seeds)
        assert plan.bound[i] == sum(most[t] for t in out) < plan.threshold[i] <= plan.bound[i] + min(most[t] for t in seeds)
        cut += len(out)
    assert cut


def test_lexical_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.ranked_search(docs.limit(0), items).collect() == []
    assert lexical_search.ranked_search(docs, items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in lexical_search.ranked_search(docs, items).collect()] == [(1, 1, 1)]


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_lexical_search"])
def test_queries_equal_sql(spark, name):
    assert compare.spark_rows(queries.QUERIES[name](spark, SF)) == compare.duck_rows(queries.ORACLE_SQL[name], SF)


def plain_ids(texts, end_id=2):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*whole.encode(t or "", add_special_tokens=False).ids, end_id] for t in texts]


def test_token_files_round_trip(spark, tmp_path):
    rng = random.Random(2)
    texts = [*ODD[:16], "<|endoftext|> a", "日本語 text", *(" ".join(rng.choice(["alpha", "beta's", "12.5", "naïve", "<tag>"]) for _ in range(rng.randrange(200))) for _ in range(300))]
    rows = [(rng.randrange(10_000), t, 9) for t in texts] + [(None, "null one", 1), (None, None, 2), (77, "same", 0), (77, "same", 0), (77, "other", 0), (-5, "below", 0)]
    folder = str(tmp_path / "ids")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5), folder)
    got = token_files.read_token_files(spark, folder, with_ids=True).collect()
    ids = plain_ids([t for _, t, _ in rows])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((i, tuple(x)) for (i, _, _), x in zip(rows, ids, strict=True))
    at = 0
    ordered = sorted(got, key=lambda r: r["start"])
    for r in ordered:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
        at += r["n_tokens"]
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in ordered]
    assert keys == sorted(keys)
    assert [x.tolist() for x in token_files.lookup(folder, -5)] == plain_ids(["below"]) and token_files.lookup(folder, 123_456) == []
    assert sorted(x.tolist() for x in token_files.lookup(folder, 77)) == sorted(plain_ids(["same", "same", "other"]))


def test_token_files_order_of_the_table(spark):
    import duckdb

    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    at, want = 0, []
    for (doc, _), ids in zip(texts, plain_ids([t for _, t in texts]), strict=True):
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op13_token_files(spark, SF).collect())) == want


def test_token_files_guard_their_content(spark, tmp_path):
    folder = str(tmp_path / "ids")
    empty = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_token_files(empty, folder)
    assert token_files.read_token_files(spark, folder).collect() == [] and token_files.lookup(folder, 1) == []
    docs = spark.createDataFrame([(n, f"short document number {n} of a kind " * 3) for n in range(3000)], "doc_id long, text string")
    small, alone = str(tmp_path / "small"), str(tmp_path / "alone")
    token_files.write_token_files(docs, small)
    token_files.write_token_files(docs, alone, dictionary=b"")
    size = lambda d: sum(os.path.getsize(f"{d}/{f}") for f in os.listdir(d) if f.endswith(".tok"))
    assert size(small) < 0.75 * size(alone)  # the dictionary pays for short documents
    # A file of an attempt that the manifest does not list is not read; one of another dictionary is refused.
    listed = json.loads(open(f"{small}/manifest.json").read())
    open(f"{small}/ids-00000000-lost.tok", "wb").write(b"half")
    assert token_files.read_token_files(spark, small).count() == 3000
    first = listed["files"][0]
    with pytest.raises(ValueError):
        token_files.TokenFile(small, first["file"], hashlib.sha256(b"").hexdigest(), first["bytes"])
    open(f"{small}/dictionary-{listed['dictionary']}.zdict", "ab").write(b"x")
    with pytest.raises(ValueError):
        token_files.lookup(small, 1)
    assert zstandard.ZstdCompressionDict(b"").as_bytes() == b""
