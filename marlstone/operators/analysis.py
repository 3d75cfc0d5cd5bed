"""Figures of a text: reading ease, grade, SMOG, and the words that occur most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T

#: Reading ease from which a text counts as so complex, by the published bands.
BANDS = ((90, "very easy"), (80, "easy"), (70, "fairly easy"), (60, "standard"), (50, "fairly difficult"), (30, "difficult"))


def polysyllables(stems: Column) -> Column:
    """The number of words with three or more syllables, from the stems of the longer words: these have five letters at least."""
    return F.regexp_count(stems, F.lit(r"(?<![^ ])(?:[^aeiouy ]*+[aeiouy]{1,2}+){3}")).cast("long")


def reading_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word_count, sentence_count, syllable_count, polysyllable_count, reading_ease, grade_level, smog_index, complexity).

    Words are what blanks part, sentences end with . ! or ? before a blank or the end, one at
    least. A text without words, or a missing one, has zeros and no complexity.
    """
    text, n_words = F.col("_text"), F.col("word_count")
    ends = F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[.!?]+(?:\s|$)"))).cast("long")
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    cut = read.select("doc_id", "_text", T.word_count(text).alias("word_count"), T.longer_words(text).alias("_found"))
    stemmed = cut.select("doc_id", "_text", "word_count", F.size("_found").alias("_longer"), T.word_stems(F.col("_found")).alias("_stems"))
    total = T.stem_syllables(F.col("_stems"), n_words, F.col("_longer"))
    counted = stemmed.select("doc_id", "word_count", F.when(n_words > 0, ends).otherwise(0).alias("sentence_count"), F.when(n_words > 0, total).otherwise(0).cast("long").alias("syllable_count"), polysyllables(F.col("_stems")).alias("polysyllable_count"))
    some = F.col("word_count") > 0
    per_sentence, per_word = F.col("word_count") / F.col("sentence_count"), F.col("syllable_count") / F.col("word_count")
    zero = lambda c: F.when(some, c).otherwise(0.0)
    ease = zero(206.835 - 1.015 * per_sentence - 84.6 * per_word)
    named = F.lit("very difficult")
    for low, name in reversed(BANDS):
        named = F.when(F.col("reading_ease") >= low, name).otherwise(named)
    figures = counted.withColumns({"reading_ease": ease, "grade_level": zero(0.39 * per_sentence + 11.8 * per_word - 15.59), "smog_index": zero(1.043 * F.sqrt(F.col("polysyllable_count") * 30 / F.col("sentence_count")) + 3.1291)})
    return figures.withColumn("complexity", F.when(some, named))


def keywords(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 12) -> DataFrame:
    """(doc_id, keywords): the ``most`` commonest tokens of each text that has any, equal counts by letters."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.explode(T.tokenize(F.col(text_col))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "term"))
    best = each.withColumn("place", place).where(F.col("place") <= most)
    return best.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("keywords"))
