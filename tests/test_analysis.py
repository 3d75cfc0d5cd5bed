"""Reading figures and keywords of small and odd texts."""

import math

from marlstone.operators import analysis


def test_figures(spark):
    rows = [(1, "The beautiful education is here. It is!"), (2, ""), (3, None), (4, " ... "), (5, "no end")]
    got = {r.doc_id: r for r in analysis.reading_figures(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one = got[1]
    # beau-ti-ful, e-du-ca-tion: two words of three syllables or more.
    assert (one.word_count, one.sentence_count, one.polysyllable_count) == (7, 2, 2)
    assert math.isclose(one.smog_index, 1.043 * math.sqrt(30) + 3.1291) and math.isclose(one.reading_ease, 206.835 - 1.015 * 3.5 - 84.6 * one.syllable_count / 7)
    for i in (2, 3):
        assert (got[i].word_count, got[i].sentence_count, got[i].syllable_count, got[i].grade_level, got[i].complexity) == (0, 0, 0, 0.0, None)
    assert (got[4].word_count, got[4].sentence_count) == (1, 1) and (got[5].sentence_count, got[5].complexity) == (1, "very easy")


def test_keywords(spark):
    rows = [(1, "Stone river stone; the river, a lake. zeta alpha"), (2, None), (3, "the a of"), (4, " ".join(f"w{i:02}" for i in range(30)))]
    got = {r.doc_id: r.keywords for r in analysis.keywords(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["river", "stone", "alpha", "lake", "zeta"], 4: [f"w{i:02}" for i in range(12)]}
