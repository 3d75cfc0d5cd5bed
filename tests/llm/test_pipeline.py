"""The stages of the corpus pipeline against plain Python, with nulls, blanks, repeats and clashing columns."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
import test_jaccard_join as jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ("size", "target", "words", "score", "taken", "passages", "root", "component_id", "set_key", "block", "base", "spans")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents, with toxic ones, groups of near copies, personal data and columns of clashing names."""
    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(20, 120)))
        toxic = i % 5 == 0
        if toxic:
            text += " " + rnd.choice(["grumblefoot", "snarkwort", "mudbrain"])
        rows.append((i, text, rnd.choice(["a", "b", "b", "b", None])))
        labels.append((i, 1, int(toxic)))
    for i in range(400, 460):  # near copies of clean documents, ids above theirs
        source = rows[(i - 400) * 5 + 1][1].split()
        source[rnd.randrange(len(source))] = "changed"
        rows.append((i, " ".join(source) if len(source) > 60 else rows[(i - 400) * 5 + 1][1], "b"))
    rows += [(460, "write to jo@example.org or +1 212 555 0100 " + " ".join(vocabulary[:30]), "a"), (461, None, "a"), (462, "", "a"), (463, " \n", None), (None, "no id " + " ".join(vocabulary[30:60]), "a"), (1, "other text of the same id " + " ".join(vocabulary[60:99]), "a"), rows[2], rows[2]]
    docs = spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def clashing(docs):
    return docs.selectExpr("*", *(f"'{c}' AS `{c}`" for c in CLASHES))


def as_rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_drop_toxic(spark, tables):
    path, rows = tables
    docs = clashing(spark.read.parquet(f"{path}/documents.parquet"))
    out = corpus_pipeline.drop_toxic(spark, docs, path)
    assert out.columns == docs.columns
    bad = re.compile("grumblefoot|snarkwort|mudbrain")
    assert as_rows(out) == Counter((i, t) for i, t, _ in rows if not bad.search(t or ""))
    assert all(r[c] == c for r in out.collect() for c in CLASHES)


def test_keep_one_of_each(spark, tables):
    path, rows = tables
    docs = clashing(spark.read.parquet(f"{path}/documents.parquet"))
    out = corpus_pipeline.keep_one_of_each(spark, docs, path)
    assert out.columns == docs.columns
    distinct = list(dict.fromkeys((i, t) for i, t, _ in rows))
    sets = [jaccard.shingles(t, 5) for _, t in distinct]
    root = list(range(len(distinct)))
    for p, a in enumerate(sets):
        for q in range(p):
            if a and sets[q] and 100 * len(a & sets[q]) >= 80 * len(a | sets[q]):
                low, high = sorted((root[p], root[q]))
                root = [low if x == high else x for x in root]
    groups = {}
    for n, (i, t) in enumerate(distinct):
        groups.setdefault(root[n], []).append((i is None, i, t))
    assert len(groups) < len(distinct)
    assert as_rows(out) == Counter((i, t) for _, i, t in (min(g, key=lambda x: (x[0], x[1] or 0)) for g in groups.values()))


def test_redact_and_mix(spark, tables):
    path, rows = tables
    docs = clashing(spark.read.parquet(f"{path}/documents.parquet"))
    out = corpus_pipeline.redact(spark, docs, path)
    assert out.columns == docs.columns and out.count() == len(rows)
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[460].startswith("write to [EMAIL] or [PHONE] ") and text[461] is None
    mixed = corpus_pipeline.mix_sources(spark, docs, path)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    own = {}
    for i, t, _ in rows:
        own.setdefault(i, set()).update(WORD.findall(t or ""))
    assert got and all(set(WORD.findall(r["text"])) <= own[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in got)
    taken, size = Counter(), Counter()
    for i, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    for r in got:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    # Sources a, b and the one without a name weigh 3, 1 and 2, and share half as much again.
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.02) and all(taken[s] <= 2.02 * size[s] for s in size)


def test_empty_tables(spark, tables):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).collect() == []


def test_run(spark, tables):
    path, rows = tables
    pieces = corpus_pipeline.run(spark, path).collect()
    held = {p["doc_id"] for p in pieces}
    bad = {i for i, t, _ in rows if re.search("grumblefoot|snarkwort|mudbrain", t or "")}
    copies = {i for i in range(400, 460)}
    assert not held & bad and not held & copies and len(held) >= 300
