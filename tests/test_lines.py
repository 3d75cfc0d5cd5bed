"""Lines of glyph runs by a tolerance with a moving anchor."""

from marlstone.sources import readers


def test_anchor_moves_by_lines_only(spark):
    runs = [(1, 1, 50.0, 99.0, "b"), (1, 1, 10.0, 101.0, "a"), (1, 1, 10.0, 96.0, " c "), (1, 1, 20.0, 93.0, "d"), (1, 1, 0.0, 92.9, "e"), (1, 1, 5.0, 50.0, ""), (1, 1, 5.0, 50.0, None), (1, 2, None, None, "z"), (1, 2, 1.0, 2.5, "y"), (2, 1, 0.0, 1.0, "q"), (2, 1, 0.0, 1.0, "p")]
    df = spark.createDataFrame(runs, "doc_id long, page int, x double, y double, text string")
    got = {(r["doc_id"], r["page"]): r["text"] for r in readers.page_text(df).collect()}
    # 101 and 99 are one line, 96 opens the next and 93 is still on it, 92.9 is not.
    assert got == {(1, 1): "a b\nc d\ne", (1, 2): "z y", (2, 1): "p q"}
    whole = {r["doc_id"]: (r["n_pages"], r["text"]) for r in readers.paged_text(df).collect()}
    assert whole[1] == (2, "--- PAGE 1 ---\n\na b\nc d\ne\n\n--- PAGE 2 ---\n\nz y")
    assert readers.page_text(df.limit(0)).collect() == []
