"""Typed blocks: what is written in each style is read back, and the grammar of nested containers."""

import random

import pytest

from marlstone.operators import containers


def _round(spark, rows, style):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    meta = containers.metadata(docs)
    cut = containers.blocks(meta)
    read = containers.container_blocks(containers.container_documents(meta, cut, "2026-01-01", style))
    fields = ("doc_id", "ord", "block_id", "type", "title", "content", "language")
    pick = lambda df: sorted((tuple(r[f] for f in fields) for r in df.collect()), key=str)
    return pick(cut), pick(read), {r.style for r in read.collect()}


@pytest.mark.parametrize("style", containers.STYLES)
def test_written_blocks_come_back(spark, style):
    rng = random.Random(3)
    parts = ["# Summary", "### How to \"ship\" {x}", "text -- here", "```py\na = 1\n\n# no\n```", "```\n\n```", "| a |\n|---|\n| 1 |", ":::", "", "```x\n:::note\n```", "- a\n- b", "## Note"]
    if style == "container":
        parts.remove(":::")
    rows = [(i, "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(500, None), (501, "long " * 200_000), (502, "# A\nopen ``` fence\n# B\nnever shut")]
    cut, read, styles = _round(spark, rows, style)
    assert cut == read and styles <= {style} and {r[0] for r in cut} == {r[0] for r in rows}


def test_metadata(spark):
    rows = [(1, "---\nTitle: 'A: b'\ntags: [x, y,, x]\nsummary: s\n---\n# T\nbody #hash #x"), (2, "# The  title \n1. No.\nThis line is the first one of prose. And more.\n**Lead Time** [[ A ]] [[A]]"), (3, "---\nauthor: B\nno end"), (4, ""), (5, None)]
    got = {r.doc_id: r for r in containers.metadata(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].title, got[1].description, got[1].tags, got[1].author) == ("A: b", "s", ["x", "y", "hash"], "AI Studio OKF Engine")
    assert (got[2].title, got[2].description, got[2].entities) == ("The  title", "This line is the first one of prose. And more.", ["A", "Lead Time"])
    assert (got[3].author, got[3].body) == ("B", "")
    for i in (4, 5):
        assert (got[i].title, got[i].description, got[i].tags, got[i].body) == ("Untitled Knowledge Document", "OKF Knowledge representation for Untitled Knowledge Document", ["knowledge", "okf", "markdown"], "")
    empty = containers.metadata(spark.createDataFrame([], "doc_id long, text string"))
    assert containers.blocks(empty).collect() == [] and containers.container_documents(empty, containers.blocks(empty), "d").collect() == []


def test_nested_containers():
    text = ':::concept "Outer" {id="a"}\none\n:::note\ninner\n```\n:::\n```\n:::\ntwo\n:::\n\nloose\n:::code {id="b" lang="py"}\n```py\nx\n```\n'
    assert containers.read_blocks(text) == [
        (None, "container", "a", "concept", "Outer", "one\ntwo", None), (0, "container", "", "note", None, "inner\n```\n:::\n```", None), (None, "container", "b", "code", None, "x", "py"),
    ]
    mixed = '<!-- okf:block id="1" type="faq" title="Q" -->\n## Q\n\nanswer\n\n### Next {#b-2 .okf-note}\n\nbody\n\n<!-- okf:content id="3" -->\nrest'
    assert [(b[1], b[2], b[3], b[4], b[5]) for b in containers.read_blocks(mixed)] == [("comment", "1", "faq", "Q", "answer"), ("attribute", "b-2", "note", "Next", "body"), ("attribute", "3", "content", None, "rest")]
    assert containers.read_blocks("") == [] and containers.read_blocks("plain\n:::\n") == []


def test_style_must_be_known(spark):
    docs = containers.metadata(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    with pytest.raises(ValueError):
        containers.container_documents(docs, containers.blocks(docs), "d", "other")
