"""Native text functions: tokens, estimates, readability, quality, types, slugs, statistics.

All are Column expressions; nothing leaves the JVM. Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the tokenizer drops.
STOPWORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by
can could did do does doing down during each few for from further had has have having he her here hers herself him
himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other
our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these
they this those through to too under until up very was we were what when where which while who whom why with would you
your yours yourself yourselves also e.g eg i.e ie etc use using used may will see note section document page
""".split()

# Words and phrases that make a text vague, by family.
VAGUE = (
    r"\b(?:maybe|perhaps|probably|likely|somehow|somewhere|sometime)\b",
    r"\b(?:stuff|things?|etc\.?|and so on|kind of|sort of)\b",
    r"\b(?:as needed|appropriately|whatever|to be decided|tbd)\b",
    r"\b(?:in theory|usually|mostly|normally)\b",
)
TABLE_RULE = r"\|(?:\s*[-:]+\s*\|)+"
FENCED = r"(?s)```.*?```"


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding of halves towards positive infinity."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def one_digit(x: Column) -> Column:
    """A number from 0.5 to a million with one digit, as C prints it: the exact value, halves to the even digit.

    ``format_string`` rounds halves of the shortest decimal up.
    """
    unit = 1 << 53
    whole = F.floor(x)
    tenths = 10 * ((x - whole) * float(unit)).cast("long")  # exact: ten times the fraction in units of 2^-53
    digit, rest = F.shiftright(tenths, 53), tenths.bitwiseAND(F.lit(unit - 1))
    rounded = 10 * whole + digit + F.when((rest > unit // 2) | ((rest == unit // 2) & (digit % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(rounded / 10), F.lit("."), rounded % 10)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def pieces(text: Column) -> Column:
    """What ``tokenize`` chooses from: lower-case text, cut at white space and all but word characters."""
    return F.split(F.regexp_replace(F.lower(text), r"[^\w\s-]", " "), r"\s+")


def is_token(word: Column) -> Column:
    return (F.length(word) > 2) & ~word.isin(*STOPWORDS)


def tokenize(text: Column) -> Column:
    """Lower-case words of three or more characters that are no stopwords."""
    return F.filter(pieces(text), is_token)


def tokens_by_chars_up(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def tokens_by_chars(text: Column) -> Column:
    return half_up(F.length(text) / 4)


def tokens_by_words(text: Column) -> Column:
    return F.ceil(word_count(text) * 1.35)


def tokens_by_words_rounded(text: Column) -> Column:
    return half_up(word_count(text) * 1.33)


def estimate_tokens(text: Column) -> Column:
    """The weighted estimate from characters and words; texts that are mostly code have shorter tokens."""
    code = F.length(F.array_join(F.regexp_extract_all(text, F.lit(FENCED), F.lit(0)), ""))
    by_chars = F.ceil(F.length(text) / F.when(code / F.length(text) > 0.4, 3.2).otherwise(3.8))
    marks = F.regexp_count(text, F.lit(r"[!@#$%^&*()_+={}\[\]:;\"'<>,.?/\\|`~-]"))
    by_words = F.ceil(word_count(text) * 1.28 + marks * 0.45)
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), half_up(by_chars * 0.4 + by_words * 0.6))).otherwise(0).cast("long")


def syllables(word: Column) -> Column:
    letters = F.regexp_replace(F.lower(word), r"[^a-z]", "")
    stem = F.regexp_replace(F.regexp_replace(letters, r"(?:[^laeiouy]|ed|es|e)$", ""), r"^y", "")
    return F.when(F.length(letters) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(stem, F.lit(r"[aeiouy]{1,2}"))))


def longer_words(text: Column) -> Column:
    """The words of four letters and more."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"[^a-z\s]", ""), F.lit(r"([a-z]{4,})"), F.lit(1))


def word_stems(found: Column) -> Column:
    """Words without the endings that do not sound, joined by blanks."""
    return F.regexp_replace(F.regexp_replace(F.array_join(found, " "), r"(?:[^laeiouy ]|ed|es|e)(?= |$)", ""), r"(^| )y", "$1")


def stem_syllables(stems: Column, n_words: Column, n_found: Column) -> Column:
    # Words of up to three letters count one, as do longer ones whose stem has no vowel.
    return n_words - n_found + F.regexp_count(stems, F.lit(r"[aeiouy]{1,2}")) + F.regexp_count(stems, F.lit(r"(?:^| )[^aeiouy ]+(?= |$)"))


def all_syllables(text: Column, n_words: Column) -> Column:
    """The sum of ``syllables`` over the words of a text, by patterns over the whole text instead of word by word."""
    found = longer_words(text)
    return stem_syllables(word_stems(found), n_words, F.size(found))


def readability(text: Column) -> dict[str, Column]:
    """word_count, sentence_count, flesch, grade and label."""
    clean = F.regexp_replace(F.regexp_replace(text, FENCED, ""), r"`[^`]+`", "")
    w = words(clean)
    n_words = F.greatest(F.lit(1), F.size(w))
    n_sentences = F.greatest(F.lit(1), F.size(F.filter(F.split(clean, r"[.!?]+(?:\s+|$)"), lambda s: F.length(F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))) > 3)))
    total = all_syllables(clean, F.size(w))
    per_sentence, per_word = n_words / n_sentences, total / n_words
    flesch = F.greatest(F.lit(0), F.least(F.lit(100), half_up(206.835 - 1.015 * per_sentence - 84.6 * per_word)))
    grade = F.greatest(F.lit(1), half_up(0.39 * per_sentence + 11.8 * per_word - 15.59))
    label = F.when(flesch >= 70, "Simple").when(flesch >= 50, "Standard").when(flesch >= 30, "Technical").otherwise("Advanced")
    return {"word_count": n_words.cast("long"), "sentence_count": n_sentences.cast("long"), "flesch": flesch.cast("long"), "grade": grade.cast("long"), "label": label}


def content_quality(text: Column) -> dict[str, Column]:
    """ambiguity, n_vague, completeness and the structure flags."""
    found = F.concat(*(F.transform(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)), lambda m: F.lower(m)) for p in VAGUE))
    distinct = F.size(F.array_distinct(found))
    n_words = F.greatest(F.lit(1), F.size(F.split(text, r"\s+")))
    steps = text.rlike(r"(?im)^\s*(?:\d+\.|\*|-)\s+(?:install|run|configure|create|open|navigate|execute|add|set|build|deploy|verify)")
    code = text.rlike(r"(?is)```[a-z0-9]*\n.*?```")
    tabular = text.rlike(TABLE_RULE)
    metrics = text.rlike(r"(?i)\b\d+(?:\.\d+)?\s*(?:%|ms|seconds?|req/s|MB|GB|KB)\b")
    score = 70 + F.when(F.length(text) > 200, 10).otherwise(0) + F.when(code | tabular | steps, 10).otherwise(0) + F.when(distinct == 0, 10).otherwise(-F.least(F.lit(25), distinct * 5))
    return {
        "ambiguity": F.least(F.lit(1.0), half_up(F.size(found) / (n_words / 30), 2)),
        "n_vague": distinct.cast("long"),
        "has_steps": steps,
        "has_code": code,
        "has_table": tabular,
        "has_metrics": metrics,
        "completeness": F.greatest(F.lit(10), F.least(F.lit(100), score)).cast("long"),
    }


def _titled(title: Column, *words_: str) -> Column:
    any_of = F.lit(False)
    for w in words_:
        any_of = any_of | F.lower(title).contains(w)
    return any_of


def concept_type(title: Column, body: Column) -> Column:
    """The type of a concept by title words and body patterns; the first rule that holds wins."""
    steps = F.regexp_count(body, F.lit(r"(?im)^\s*(?:\d+\.|\bstep\s*\d+:)"))
    orders = F.regexp_count(body, F.lit(r"(?i)\b(?:install|configure|run|execute|create|set up|download|click|navigate|open|deploy)\b"))
    return (
        F.when(body.rlike(TABLE_RULE) & _titled(title, "table", "schema", "matrix", "data"), "table")
        .when(_titled(title, "how to", "procedure", "workflow", "guide", "steps", "installation") | ((steps >= 2) & (orders >= 2)), "procedure")
        .when(_titled(title, "metric", "kpi", "benchmark", "latency", "performance", "stat", "sla"), "metric")
        .when(_titled(title, "guideline", "rule", "policy", "standard", "compliance") | body.rlike(r"(?i)\b(?:must|shall|mandatory|prohibited|forbidden|required to)\b"), "guideline")
        .when(_titled(title, "api", "reference", "spec", "glossary", "dictionary") | body.rlike(r"\b(?:GET|POST|PUT|DELETE|PATCH)\s+/api/"), "reference")
        .otherwise("concept")
    )


def section_type(title: Column, body: Column) -> Column:
    """The simpler type of a section, by title first."""
    return (
        F.when(_titled(title, "how to", "procedure", "guide", "steps", "workflow", "setup", "installation") | body.rlike(r"(?m)^\s*1\.\s+"), "procedure")
        .when(_titled(title, "table", "data", "sheet", "matrix", "schema") | body.rlike(TABLE_RULE), "table")
        .when(_titled(title, "metric", "benchmark", "kpi", "stat", "score"), "metric")
        .when(_titled(title, "policy", "rule", "guideline", "standard", "compliance"), "guideline")
        .when(_titled(title, "api", "reference", "spec", "dictionary", "glossary"), "reference")
        .otherwise("concept")
    )


def slug_words(title: Column, most: int = 60) -> Column:
    """Words joined by hyphens, underscores kept."""
    s = F.substring(F.regexp_replace(F.trim(F.regexp_replace(F.lower(title), r"[^\w\s-]", "")), r"\s+", "-"), 1, most)
    return F.when(s == "", "untitled-concept").otherwise(s)


def slug_ascii(title: Column) -> Column:
    """Runs of other characters become one hyphen, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", "unnamed").otherwise(s)


def slug_section(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-")


def slug_tag(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), r"[^\w\s-]", ""), r"\s+", "-")


def clean_id(path: Column) -> Column:
    """A lower-case id without leading dots and slashes or the ending .md."""
    return F.regexp_replace(F.regexp_replace(F.lower(path), r"^[./]+", ""), r"\.md$", "")


# Tags looked for as substrings.
SUBJECT_TAGS = "architecture security auth database storage rag graph sparql agent mcp cli validation protocol api procedure consensus testing deployment workflow llm configuration".split()


def subject_tags(title: Column, body: Column) -> Column:
    both = F.lower(F.concat_ws(" ", title, body))
    return F.slice(F.filter(F.array(*(F.lit(t) for t in SUBJECT_TAGS)), lambda t: both.contains(t)), 1, 5)


def description(title: Column, body: Column) -> Column:
    """The first sentence of the body if of a fitting length, else a phrase with the title."""
    b = F.regexp_replace(body, r"(?m)^#+\s+.+$", "")
    b = F.regexp_replace(b, FENCED, "")
    b = F.regexp_replace(b, r"\[([^\]]+)\]\([^)]+\)", "$1")
    b = F.regexp_replace(F.regexp_replace(b, r"[*_`#]", ""), r"^\s+|\s+$", "")
    first = F.get(F.split(b, r"(?<=[.?!])\s+"), 0)
    return F.when(F.length(first).between(15, 160), F.trim(F.regexp_replace(first, "\n", " "))).otherwise(F.concat(F.lit("Specifications and directives regarding "), F.lower(title), F.lit(" in the system.")))


def salient_sentence(body: Column, title: Column) -> Column:
    """The best of the sentences of 25 to 220 characters; the first of equals."""
    b = F.regexp_replace(body, FENCED, " ")
    b = F.regexp_replace(b, r"(?m)^#+\s+.*$", "")
    b = F.regexp_replace(b, r"!\[.*?\]\(.*?\)", "")
    b = F.regexp_replace(F.regexp_replace(b, r"\[([^\]]+)\]\([^)]+\)", "$1"), r"[*_`]", "")
    trimmed = F.transform(F.split(F.regexp_replace(b, r"^\s+|\s+$", ""), r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    kept = F.filter(trimmed, lambda s: F.length(s).between(25, 220))
    of_title = tokenize(title)

    def scored(s: Column, i: Column) -> Column:
        points = F.when(i == 0, 4.0).when(i == 1, 2.5).otherwise(0.0)
        points = points + F.when(s.rlike(r"(?i)\b(?:is a|is an|defines|provides|specifies|represents|implements|used for|allows|enables)\b"), 5).otherwise(0)
        points = points + 2 * F.size(F.filter(tokenize(s), lambda t: F.array_contains(of_title, t)))
        points = points - F.when(F.right(s, F.lit(1)).isin("?", ":"), 3).otherwise(0) - F.when(s.rlike(r"(?i)^(?:for example|such as|note that|specifically)"), 2).otherwise(0)
        return F.struct((-points).alias("cost"), i.alias("at"), s.alias("s"))

    best = F.regexp_replace(F.array_min(F.transform(kept, scored))["s"], r"\s+", " ")
    ended = F.when(best.endswith("."), best).otherwise(F.concat(best, F.lit(".")))
    return F.when(F.size(kept) == 0, F.concat(title, F.lit(" concept document and specification."))).otherwise(ended)


def document_statistics(text: Column) -> dict[str, Column]:
    """Counts of structure in a Markdown text."""
    n = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    images = n(r"!\[.*?\]\(.*?\)")
    n_words = word_count(text)
    sentences = F.greatest(F.lit(1), n(r"[.!?]+(?=\s|$)"))
    grade = half_up(0.39 * (n_words / sentences) + 11.8 * 1.35 - 15.59)
    blocks = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    prose = F.size(F.filter(blocks, lambda p: (p != "") & ~p.rlike(r"^(?:[#|*+-]|```|\d+\.)")))
    return {
        "chars": F.length(text).cast("long"),
        "words": n_words,
        "reading_minutes": F.greatest(F.lit(1), F.ceil(n_words / 200)).cast("long"),
        "h1": n(r"(?m)^#\s+"),
        "h2": n(r"(?m)^##\s+"),
        "h3": n(r"(?m)^###\s+"),
        "deeper": n(r"(?m)^####+\s+"),
        "code_blocks": F.floor(n(r"(?m)^```") / 2).cast("long"),
        "inline_code": n(r"`[^`\n]+`"),
        "images": images,
        "links": F.greatest(F.lit(0), n(r"\[.*?\]\(.*?\)") - images).cast("long"),
        "bullets": n(r"(?m)^\s*[-*+]\s+"),
        "numbered": n(r"(?m)^\s*\d+\.\s+"),
        "paragraphs": F.greatest(F.lit(1), prose).cast("long"),
        "formulas": (F.floor(n(r"\$\$") / 2) + n(r"\$[^\$\n]+\$")).cast("long"),
        "grade": F.when(n_words == 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(18), grade))).cast("long"),
    }


def diagram_type(code: Column) -> Column:
    """The kind of a diagram by the start of its text."""
    c = F.lower(F.trim(code))
    out = None
    for start, name in (("graph", "flowchart"), ("flowchart", "flowchart"), ("sequencediagram", "sequence"), ("classdiagram", "class"), ("erdiagram", "er"), ("gantt", "gantt"), ("pie", "pie")):
        out = F.when(c.startswith(start), name) if out is None else out.when(c.startswith(start), name)
    return out.otherwise("unknown")


def latex_symbols(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\\[a-zA-Z]+"), F.lit(0)))


# Numbers in words.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "ten": 10, "fourteen": 14, "thirty": 30, "sixty": 60, "ninety": 90, "one hundred": 100, "one hundred and twenty": 120}


def number_of(raw: Column) -> Column:
    named = F.create_map(*(F.lit(x) for kv in NUMBER_WORDS.items() for x in kv))
    digits = F.regexp_extract(raw, r"^\s*(\d+)", 1)
    return F.when(digits != "", digits.cast("long")).otherwise(F.coalesce(F.try_element_at(named, F.lower(F.trim(raw))), F.lit(1)).cast("long"))


def unit_of(raw: Column) -> Column:
    u = F.lower(raw)
    return F.when(u.contains("hour"), "hours").when(u.contains("business") | u.contains("working"), "business_days").when(u.contains("week"), "weeks").when(u.contains("month"), "months").when(u.contains("year"), "years").otherwise("days")


def lexical_word(word: Column) -> Column:
    """Whether a word has a vowel and no run of four equal consonants."""
    w = F.lower(word)
    return w.rlike(r"[aeiouy]") & ~w.rlike(r"([bcdfghjklmnpqrstvwxz])\1{3,}")


def byte_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n, F.lit(" B"))).when(n < 1048576, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", n / 1048576), F.lit(" MB")))


def token_label(n: Column) -> Column:
    return F.when(n < 1000, F.concat(n, F.lit(" tokens"))).otherwise(F.concat(F.format_string("%.1f", n / 1000), F.lit("k tokens")))


def clean_markdown(text: Column) -> Column:
    """Drops progress lines and banners, and unwraps a text that is one Markdown fence."""
    t = F.regexp_replace(text, r"(?m)^>\s*(?:🛰️|⏱️|🧬|🪟|⚡|⚠️|❌)\s*.*$\n?", "")
    t = F.regexp_replace(t, r"(?m)^>\s*\[(?:Server Stage|Server Heartbeat|Server Error|Gemini Model Retry).*?$\n?", "")
    t = F.regexp_replace(t, r"(?m)^###\s*(?:🪟.*?|Window\s+\d+\s+of\s+\d+.*?)$\n?", "")
    t = F.regexp_replace(t, r"(?m)^(?:---\s*\n\s*)?\*(?:Document Conversion Complete|Complete Stream Delivered|All Pages Converted).*?\*\s*$", "")
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    wrapped = t.rlike(r"(?s)^```(?:markdown|md)\n.*```$")
    return F.when(wrapped, F.regexp_replace(F.regexp_replace(t, r"^```(?:markdown|md)\r?\n", ""), r"\r?\n```$", "")).otherwise(t)
