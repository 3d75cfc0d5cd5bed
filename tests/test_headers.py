"""Headers: what the three readings make of the same text, nested structures, and documents parsed whole."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import headers, markdown

SAMPLE = """title: "A: b # c"
count: 3
share: 0.50
on: true
none:
tags: [x, 'y, z', 2]
list:
  - one
  - 2
deep:
  by: ann
  at:
    - day: 2024-01-31
      ok: false
    - day: ~
note: plain # comment"""


def test_three_readings():
    nested, typed, flat = headers.nested_yaml(SAMPLE), headers.typed_yaml(SAMPLE), markdown.flat_yaml(SAMPLE)
    assert nested == {"title": "A: b # c", "count": 3, "share": 0.5, "on": True, "none": None, "tags": ["x", "y, z", 2], "list": ["one", 2], "deep": {"by": "ann", "at": [{"day": "2024-01-31", "ok": False}, {"day": None}]}, "note": "plain"}
    # Typed: comments cut everywhere, inline lists cut at every comma, nesting lost: inner keys stand beside outer ones.
    assert typed["title"] == "A: b" and typed["count"] == 3 and typed["on"] is True and typed["none"] is None and typed["tags"] == ["x", "y", "z", "2"]
    assert typed["list"] == ["one", 2] and typed["deep"] is None and typed["by"] == "ann" and typed["note"] == "plain" and typed["at"] == ["day: 2024-01-31"] and typed["ok"] == ["day: ~"]
    # Flat: everything is text.
    assert flat["count"] == "3" and flat["list"] == "one, 2" and flat["note"] == "plain # comment"


@pytest.mark.parametrize(
    "text,want",
    [
        ("a: 1\nb:\n- x\n- - y\n  - z\nc: {k: [1, {m: n}], 'q r': \"s\\nt\"}", {"a": 1, "b": ["x", ["y", "z"]], "c": {"k": [1, {"m": "n"}], "q r": "s\nt"}}),
        ("t: |\n  one\n   two\n\n  three\nu: >-\n  a\n  b\n\n  c\nv: |+\n  k\n\nw: end", {"t": "one\n two\n\nthree\n", "u": "a b\nc", "v": "k\n\n", "w": "end"}),
        ("a: [1,\n  2,\n  3]\nb: long\n  text\nurl: http://x.y/z\n'q': it''s", {"a": [1, 2, 3], "b": "long text", "url": "http://x.y/z", "q": "it''s"}),
        ("- a\n- b: 1\n  c: 2", ["a", {"b": 1, "c": 2}]), ("", None), ("# only a comment", None), ("just text", "just text"), ("a:\n  b:\n    c: 'x''y'", {"a": {"b": {"c": "x'y"}}}), ("e: 1e3\nf: -.5\ng: +7\nh: 1.2.3", {"e": 1000.0, "f": -0.5, "g": 7, "h": "1.2.3"}),
    ],
)
def test_nested(text, want):
    assert headers.nested_yaml(text) == want


@pytest.mark.parametrize("text", ["a: 1\na: 2", "a: [1, 2", 'a: "open', "a: 1\n   b: 2", "a: 1\n\tb: 2", "a: &x 1", "a:\n  b: 1\n c: 2", "a: 1\nno key here"])
def test_malformed(text):
    with pytest.raises(ValueError):
        headers.nested_yaml(text)


def test_headers_as_variant(spark):
    docs = [(1, f"---\n{SAMPLE}\n---\n# H\nbody"), (2, "no header"), (3, "---\nopen: 1\n"), (4, None), (5, "---\n- a\n---\nx"), (6, "---\na: 1\na: 2\n---\ny"), (7, "")]
    df = headers.parsed_headers(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in df.select("doc_id", F.to_json("header").alias("json"), F.try_variant_get("header", "$.deep.at[0].day", "string").alias("day"), "body", "raw", "error").collect()}
    assert json.loads(got[1]["json"]) == headers.nested_yaml(SAMPLE) and got[1]["day"] == "2024-01-31" and got[1]["body"] == "# H\nbody"
    assert [got[i]["json"] for i in range(2, 8)] == ["{}"] * 6 and got[2]["body"] == "no header" and got[3]["raw"] is None and got[4]["body"] == ""
    assert got[5]["error"] is None and got[6]["error"] == "a twice" and got[6]["body"] == "y"


def test_documents_whole(spark):
    text = "---\ntype: procedure\ntitle: Ship it\ndepends-on: [a, b]\nverified-by: ann\nstatus: stable\n---\n# One\nsee [[X]] and [l](u.md) `[[no]]`\n## Two\n```py\n# no\n```\n:::note T\nin\n:::\n"
    docs = spark.createDataFrame([(1, text, "./n/ship.md"), (2, "plain words [[Y|z]]", None), (3, None, "")], "doc_id long, text string, path string")
    got = {r["doc_id"]: r for r in headers.parse_documents(docs, path_col="path").drop("header").collect()}
    assert tuple(got[1]) == (1, "n/ship", "procedure", "Ship it", "stable", "human-reviewed", ["a", "b"], 17, 17, 2, 1, 1, 1, 1)
    assert tuple(got[2]) == (2, "unnamed", "concept", None, None, "machine-confirmed", [], 1, 3, 1, 1, 0, 0, 0)
    assert got[3]["n_words"] == 0 and got[3]["id"] == "unnamed"
