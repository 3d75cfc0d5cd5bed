"""Part-of-speech tags of tokens: sets of tags with parents, given by form and then by neighbours.

A sentence is one array of tokens, so the rules that look at neighbours read the array's places before
and after; they read forms and first tags only, and their order does not matter. All native, in one
narrow pass. Characters outside ASCII letters, digits, "_", "'" and "-" part tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tags and their parents.
PARENTS = {
    "Noun": None, "ProperNoun": "Noun", "Person": "ProperNoun", "Organization": "ProperNoun", "Place": "ProperNoun", "TechnicalTerm": "ProperNoun", "Acronym": "TechnicalTerm", "Value": None, "Unit": "Value",
    "Verb": None, "Adjective": None, "Adverb": None, "Pronoun": None, "Conjunction": None, "Preposition": None, "Determiner": None,
}
# Titles of persons, endings of organisations, suffixes of technical terms, words that carry nothing.
PERSON_TITLES = "dr prof mr mrs ms sir president author creator founder ceo cto".split()
ORG_SUFFIXES = "inc corp llc ltd foundation group lab labs team institute consortium association dao".split()
TECH_SUFFIXES = "db ql sql js ts py engine protocol algorithm network cluster".split()
STOPWORDS = """
a about above after again against all am an and any are as at
be because been before being below between both but by
can could did do does doing down during each few for from further
had has have having he her here hers herself him himself his how
i if in into is it its itself just me more most my myself
no nor not now of off on once only or other our ours ourselves
out over own same she should so some such than that the their
theirs them themselves then there these they this those through to too
under until up very was we were what when where which while who
whom why with would you your yours yourself yourselves also e.g i.e
etc note see example page doc docs using used file files true false
null undefined return const let var function class import export from
""".split()

_SENTENCE = r"(?<=[.?!])\s+(?=[A-Z0-9`\"'])|\n+"
_TOKEN = r"`[^`]+`|[\w'-]+"
_VALUE = r"(?i)^\d+(\.\d+)?(%|ms|s|kb|mb|gb|tb|hz|ghz|k|m|b)?$"


def _tags(*names: str) -> Column:
    return F.array(*(F.lit(n) for n in names)) if names else F.expr("cast(array() as array<string>)")


def _form(raw: Column) -> Column:
    """A token's text, normal form and looks. Patterns are only tried where the first character admits them."""
    ticked = raw.startswith("`")
    text = F.when(ticked, F.regexp_replace(raw, "^`|`$", "")).otherwise(raw)
    # Outside ticks a token has ASCII letters, digits, "_", "-" and "'" only.
    normal = F.when(ticked, F.regexp_replace(F.lower(F.regexp_replace(raw, "^`|`$", "")), r"[^\w-]", "")).otherwise(F.replace(F.lower(raw), F.lit("'"), F.lit("")))
    return F.struct(
        text.alias("token"), normal.alias("normal"), ticked.alias("ticked"), ((text < "[") & text.rlike(r"^[A-Z][a-z0-9]")).alias("capital"),
        ((text < "`") & text.rlike(r"^[A-Z0-9_-]{2,}$") & text.rlike("[A-Z]")).alias("upper"),
    )


def _first_tags(t: Column) -> Column:
    """Tags by form, each once: code in ticks, values, acronyms, suffixes, endings, capitals."""
    normal = t["normal"]
    technical = reduce(lambda a, b: a | b, (normal.endswith(s) & (F.length(normal) > len(s) + 2) for s in TECH_SUFFIXES))
    ends = lambda *suffixes: reduce(lambda a, b: a | b, (normal.endswith(s) for s in suffixes))

    def by_ending(before: tuple[str, ...], after: tuple[str, ...]) -> Column:
        # Every case is a constant, so that a token's tests are made once.
        given = lambda *tag: _tags(*dict.fromkeys((*before, *tag, *after) or ("Noun",)))
        return F.when(ends("ing", "ed"), given("Verb")).when(ends("ly"), given("Adverb")).when(ends("able", "ible", "al", "ive"), given("Adjective")).when(ends("tion", "sion", "ment", "ity"), given("Noun")).otherwise(given())

    by_suffix = lambda *after: F.when(technical, by_ending(("TechnicalTerm", "Noun"), after)).otherwise(by_ending((), after))
    plain = F.when(t["capital"] & ~normal.isin(*STOPWORDS), by_suffix("ProperNoun", "Noun")).otherwise(by_suffix())
    value = F.when(t["token"].rlike("(?i)[a-z%]"), _tags("Value", "Unit")).otherwise(_tags("Value"))
    is_value = (t["token"] < ":") & t["token"].rlike(_VALUE)
    return F.when(t["ticked"], _tags("TechnicalTerm", "ProperNoun", "Noun")).when(is_value, value).when(t["upper"] & F.length(normal).between(2, 7), _tags("Acronym", "TechnicalTerm", "ProperNoun", "Noun")).otherwise(plain)


def _in_context(t: Column, i: Column, all_: Column) -> Column:
    """First tags and those by neighbours: a noun behind determiner and adjective, persons by title, organisations by suffix, compound names."""
    at = lambda k: F.get(all_, i + k)  # noqa: E731  null outside the sentence
    yes = lambda c: F.coalesce(c, F.lit(False))
    when = lambda c, *names: F.when(c, _tags(*names)).otherwise(_tags())
    described = yes(at(-2)["normal"].isin("the", "a", "an", "this") & F.array_contains(at(-1)["first"], "Adjective"))
    titled = t["capital"] & yes(at(-1)["normal"].isin(*PERSON_TITLES))
    suffixed = t["capital"] & yes(at(1)["normal"].isin(*ORG_SUFFIXES))
    compound = t["capital"] & t["token"].rlike(r"^[A-Z][a-z0-9]+[A-Z][a-zA-Z0-9]+$")
    more = F.concat(t["first"], when(described, "Noun"), when(titled, "Person", "ProperNoun"), when(suffixed, "Organization", "ProperNoun"), when(compound, "TechnicalTerm", "ProperNoun"))
    return F.when(described | titled | suffixed | compound, F.array_distinct(more)).otherwise(t["first"])


def tagged_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence, tokens): of each sentence its tokens (token, normal, tags). A null or blank text has none."""
    trimmed = F.filter(F.transform(F.split(text_col, _SENTENCE), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    sentences = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(trimmed).alias("sentence", "_s"))
    # A pair of ticks around nothing is no token; one alone is punctuation.
    forms = sentences.withColumn("_forms", F.transform(F.regexp_extract_all("_s", F.lit(_TOKEN), F.lit(0)), _form))
    first = forms.withColumn("_first", F.transform("_forms", lambda t: F.struct(t["token"].alias("token"), t["normal"].alias("normal"), t["capital"].alias("capital"), _first_tags(t).alias("first"))))
    tokens = F.transform("_first", lambda t, i: F.struct(t["token"].alias("token"), t["normal"].alias("normal"), _in_context(t, i, F.col("_first")).alias("tags")))
    return first.select("doc_id", "sentence", tokens.alias("tokens"))


def is_a(tags: Column, tag: str) -> Column:
    """Whether a set of tags holds a tag or one below it."""
    below = {tag}
    while more := {t for t, p in PARENTS.items() if p in below} - below:
        below |= more
    return F.arrays_overlap(tags, _tags(*sorted(below)))


def tagged_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence, place, phrase): runs of two or more salient tokens, in their order."""
    found = tagged_sentences(docs, id_col, text_col)
    # Tokens that are not salient part the runs.
    marked = F.transform("tokens", lambda t: F.when((F.arrays_overlap(t["tags"], _tags("ProperNoun", "TechnicalTerm", "Noun", "Acronym"))) & ~t["normal"].isin(*STOPWORDS), t["token"]).otherwise(F.lit("\x00")))
    runs = F.filter(F.transform(F.split(F.array_join(marked, "\x01"), "\x00"), lambda r: F.filter(F.split(r, "\x01"), lambda w: w != "")), lambda r: F.size(r) >= 2)
    return found.select("doc_id", "sentence", F.posexplode(runs).alias("place", "_run")).select("doc_id", "sentence", "place", F.array_join("_run", " ").alias("phrase"))
