"""Registered queries of the text functions, similarity and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import analysis, entities, retrieval, similarity, tagger
from marlstone.plans import inputs
from marlstone.session import table

_WORDS = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TOKENS = rf"list_filter(string_split_regex(regexp_replace(lower({{0}}), '[^\w\s-]', ' ', 'g'), '\s+'), lambda x: length(x) > 2 AND x NOT IN ({_WORDS}))"
_TITLE = "substring(text, 1, 40)"
QUERY = "the erthnd retion"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in T.document_statistics(F.col("text")).items()))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", T.tokens_by_chars_up(t).alias("chars_up"), T.tokens_by_chars(t).alias("chars_near"), T.tokens_by_words(t).alias("words_up"), T.tokens_by_words_rounded(t).alias("words_near"), T.estimate_tokens(t).alias("estimate"))


def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in T.readability(F.col("text")).items()))


def content_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in T.content_quality(F.col("text")).items()))


def types_and_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, body = F.substring("text", 1, 40), F.col("text")
    return _docs(spark, sf_dir).select("doc_id", T.concept_type(title, body).alias("concept_type"), T.section_type(title, body).alias("section_type"), T.slug_words(title).alias("slug_words"), T.slug_ascii(title).alias("slug_ascii"), T.slug_section(title).alias("slug_section"))


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = similarity.term_frequencies(_docs(spark, sf_dir), "doc_id", F.col("text"))
    return tf.select(F.col("id").alias("doc_id"), "term", "n", F.round("tf", 8).alias("tf"))


def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held = docs.select(F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term"))
    return similarity.inverse_frequencies(held, docs.count()).select("term", "df", F.round("idf", 8).alias("idf"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    tf = similarity.term_frequencies(items, "item_id", F.col("text"))
    return similarity.cosine_pairs(similarity.weights(tf, similarity.inverse_frequencies(tf, items.count()))).select("a", "b", F.round("cosine", 6).alias("cosine"))


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("item"))
    return similarity.jaccard_pairs(items).select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


def keyphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.keyphrases(_docs(spark, sf_dir)).select("doc_id", F.col("rank").cast("long").alias("rank"), "phrase", "weight")


def tfidf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.tfidf_scores(_docs(spark, sf_dir), "doc_id", F.col("text"), QUERY)
    return found.select(F.col("id").alias("doc_id"), F.round("cosine", 6).alias("cosine")).orderBy(F.desc("cosine"), "doc_id").limit(20)


def reading_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.reading_figures(table(spark, sf_dir, "documents"))
    return found.select(*(F.round(c, 6).alias(c) if c in ("reading_ease", "grade_level", "smog_index") else c for c in found.columns))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.keywords(table(spark, sf_dir, "documents")).select("doc_id", F.array_join("keywords", " ").alias("keywords"))


#: Names the first supplier, so that its title is boosted; the entities boost what names them.
ASKED = "compare supplier#000000001 with others that ship from nation_1"


def boosted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.tfidf_search(inputs.concepts(spark, sf_dir), ASKED, 1000, "human-reviewed", ("nation_1", "procedure", "region_2"))
    return found.select("id", F.round("score", 6).alias("score"))


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_search(inputs.concepts(spark, sf_dir), "nation_1", 10)


def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.concepts(spark, sf_dir)
    return c.select("id", F.round(retrieval.lexical_score("supplier of region install", F.col("title"), F.col("description"), F.col("tags"), F.col("body")), 6).alias("score"))


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranked = lambda c: retrieval.global_rank(docs.select(F.col("doc_id").alias("id"), c.alias("v")), [F.desc("v"), F.col("id")]).select("id", "rank")
    return retrieval.reciprocal_rank_fusion([ranked(F.length("text")), ranked(T.word_count(F.col("text")))]).select(F.col("id").alias("doc_id"), F.round("score", 8).alias("score"))


def dense_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    query = [float(x) for x in v.where("vec_id = 0").select("embedding").first()[0]]
    return retrieval.dense_top_k(v, query, 10).select("vec_id", F.round("cosine", 6).alias("cosine"))


#: Texts with names of every kind; Spark and DuckDB share the statement.
PATTERNED = r"""
SELECT s_suppkey AS id, 'Use getUser' || CAST(s_suppkey % 3 AS STRING) || ' and API_KEY via ' ||
  CASE s_suppkey % 6 WHEN 0 THEN 'REST' WHEN 1 THEN 'restful' WHEN 2 THEN 'OAuth 2.0' WHEN 3 THEN 'oauth' WHEN 4 THEN 'HTTPS' ELSE 'kubernetes' END || ' at ' || CAST(s_suppkey AS STRING) || ' ms or 99.9% of 5 Tokens. THE ABC is AND, `tick ' || CAST(s_suppkey AS STRING) || '` `the` ` ABC ` `' ||
  s_name || '` with snake_case_' || CAST(s_suppkey % 5 AS STRING) || ' MyClassName go C++x SDKs ABCDEF XYZ' ||
  CASE WHEN s_suppkey % 4 = 0 THEN ' a_1 a_2 a_3 a_4 a_5 a_6 a_7 a_8 a_9' ELSE '' END AS text
FROM supplier
"""


def budgeted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order within a budget of tokens, some without any."""
    docs = table(spark, sf_dir, "documents")
    tokens = F.when(F.col("doc_id") % 7 == 3, 0).otherwise(F.floor(F.length("text") / 40))
    return retrieval.within_budget(docs.select("doc_id", tokens.alias("tokens")), [F.col("doc_id")], F.col("tokens"), 3000)


def pattern_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.sql(spark, sf_dir, PATTERNED)
    return c.select("id", F.posexplode(entities.pattern_entities(F.col("text"))).alias("at", "e")).select("id", (F.col("at") + 1).cast("long").alias("place"), "e.text", "e.category", "e.confidence")


def noun_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.noun_phrases(entities.tagged_tokens(table(spark, sf_dir, "benchmark"), "item_id", "text"))


#: Documents behind sentences that every rule of neighbours meets, by number; Spark and DuckDB share the statement.
TAGGED = """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Dr. Lamport met Prof Knuth at the Linux Foundation. The practical fault is a VectorIndex, in 250ms and 99.9% of cases!' WHEN 1 THEN 'President of it: the BM25 score of `a b` and GraphQL. a natural thing; A viable Thing Labs' ELSE 'MyDB engines, running quickly? 12 MB of PostgreSQL - this final MCP' END ||
  CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE ' ' END || text AS text
FROM documents
"""


def contextual_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of each document have each tag."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    found = tagger.tagged_sentences(spark.sql(TAGGED))
    return found.select("doc_id", F.explode(F.flatten(F.transform("tokens", lambda t: t["tags"]))).alias("tag")).groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


def tagged_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each run of salient tokens stands in a document."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return tagger.tagged_phrases(spark.sql(TAGGED)).groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


def lexicon_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.array(F.concat(F.lit("land "), "n_name")).alias("aliases"), F.lit("place").alias("category"), F.lit(0.5).alias("salience"), (F.col("n_nationkey") != 3).alias("enabled"))
    return entities.lexicon_matches(inputs.concepts(spark, sf_dir), lexicon, "id", "body").select("doc_id", "name", "occurrences", F.round("salience", 6).alias("salience"), "tag")


def tag_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = inputs.concepts(spark, sf_dir).select(F.col("id").alias("node"), F.explode(F.array("tag_a", "tag_b", "type")).alias("tag"))
    return entities.cooccurrence(tags)


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.concepts(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


_SYLLABLES = r"CASE WHEN length(regexp_replace(lower(w), '[^a-z]', '', 'g')) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(lower(w), '[^a-z]', '', 'g'), '(?:[^laeiouy]|ed|es|e)$', ''), '^y', ''), '[aeiouy]{1,2}'))) END"
_N = lambda p, c="text": f"CAST(len(regexp_extract_all({c}, '{p}')) AS BIGINT)"
_HAS = lambda *w: "(" + " OR ".join(f"contains(lower({_TITLE}), '{x}')" for x in w) + ")"
_VAGUE = " + ".join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in T.VAGUE)
_VAGUE_LIST = "list_distinct(list_transform(list_concat(" + ", list_concat(".join(f"regexp_extract_all(text, '(?i){p}')" for p in T.VAGUE[:-1]) + f", regexp_extract_all(text, '(?i){T.VAGUE[-1]}')" + ")" * (len(T.VAGUE) - 1) + ", lambda x: lower(x)))"
_STEPS = r"regexp_matches(text, '(?im)^\s*(?:\d+\.|\*|-)\s+(?:install|run|configure|create|open|navigate|execute|add|set|build|deploy|verify)')"
_CODE = r"regexp_matches(text, '(?is)```[a-z0-9]*\n.*?```')"
_TABLE = rf"regexp_matches(text, '{T.TABLE_RULE}')"

_TOKENS_TAGGED = rf"""WITH d AS ({TAGGED}), """ + r"""s AS (
          SELECT doc_id, generate_subscripts(l, 1) AS sentence, trim(unnest(l), chr(32) || chr(9) || chr(13)) AS s FROM (
            SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.?!])\s+([A-Z0-9`"''])', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g'), chr(1)) AS l FROM d)
        ), k AS (
          SELECT doc_id, sentence, generate_subscripts(m, 1) AS i, unnest(m) AS raw FROM (SELECT doc_id, sentence, regexp_extract_all(s, '`[^`]+`|[0-9A-Za-z_''-]+') AS m FROM s)
        ), t AS (
          SELECT doc_id, sentence, i, raw[1] = '`' AS ticked, regexp_replace(raw, '^`|`$', '', 'g') AS token, regexp_replace(lower(regexp_replace(raw, '^`|`$', '', 'g')), '[^0-9A-Za-z_-]', '', 'g') AS normal FROM k
        ), f AS (
          SELECT *, regexp_matches(token, '^[A-Z][a-z0-9]') AS capital, normal IN ('a', 'about', 'above', 'after', 'again', 'against', 'all', 'am', 'an', 'and', 'any', 'are', 'as', 'at', 'be', 'because', 'been', 'before', 'being', 'below', 'between', 'both', 'but', 'by', 'can', 'could', 'did', 'do', 'does', 'doing', 'down', 'during', 'each', 'few', 'for', 'from', 'further', 'had', 'has', 'have', 'having', 'he', 'her', 'here', 'hers', 'herself', 'him', 'himself', 'his', 'how', 'i', 'if', 'in', 'into', 'is', 'it', 'its', 'itself', 'just', 'me', 'more', 'most', 'my', 'myself', 'no', 'nor', 'not', 'now', 'of', 'off', 'on', 'once', 'only', 'or', 'other', 'our', 'ours', 'ourselves', 'out', 'over', 'own', 'same', 'she', 'should', 'so', 'some', 'such', 'than', 'that', 'the', 'their', 'theirs', 'them', 'themselves', 'then', 'there', 'these', 'they', 'this', 'those', 'through', 'to', 'too', 'under', 'until', 'up', 'very', 'was', 'we', 'were', 'what', 'when', 'where', 'which', 'while', 'who', 'whom', 'why', 'with', 'would', 'you', 'your', 'yours', 'yourself', 'yourselves', 'also', 'e.g', 'i.e', 'etc', 'note', 'see', 'example', 'page', 'doc', 'docs', 'using', 'used', 'file', 'files', 'true', 'false', 'null', 'undefined', 'return', 'const', 'let', 'var', 'function', 'class', 'import', 'export', 'from') AS stop,
            regexp_matches(normal, '^.{3,}(db|ql|sql|js|ts|py|engine|protocol|algorithm|network|cluster)$') AS tech,
            CASE WHEN regexp_matches(normal, '(ing|ed)$') THEN 'Verb' WHEN regexp_matches(normal, 'ly$') THEN 'Adverb' WHEN regexp_matches(normal, '(able|ible|al|ive)$') THEN 'Adjective' WHEN regexp_matches(normal, '(tion|sion|ment|ity)$') THEN 'Noun' END AS ending
          FROM t
        ), g AS (
          SELECT *, CASE WHEN ticked THEN ['TechnicalTerm', 'ProperNoun', 'Noun']
              WHEN regexp_matches(token, '(?i)^\d+(\.\d+)?(%|ms|s|kb|mb|gb|tb|hz|ghz|k|m|b)?$') THEN CASE WHEN regexp_matches(token, '(?i)[a-z%]') THEN ['Value', 'Unit'] ELSE ['Value'] END
              WHEN regexp_matches(token, '^[A-Z0-9_-]{2,}$') AND regexp_matches(token, '[A-Z]') AND length(normal) BETWEEN 2 AND 7 THEN ['Acronym', 'TechnicalTerm', 'ProperNoun', 'Noun']
              ELSE list_filter([CASE WHEN tech THEN 'TechnicalTerm' END, CASE WHEN tech THEN 'Noun' END, ending, CASE WHEN capital AND NOT stop THEN 'ProperNoun' END, CASE WHEN (capital AND NOT stop) OR (NOT tech AND ending IS NULL) THEN 'Noun' END], lambda x: x IS NOT NULL) END AS first
          FROM f
        ), c AS (
          SELECT doc_id, sentence, i, token, stop, list_distinct(first || list_filter([
              CASE WHEN lag(normal, 2) OVER w IN ('the', 'a', 'an', 'this') AND list_contains(lag(first) OVER w, 'Adjective') THEN 'Noun' END,
              CASE WHEN lag(normal) OVER w IN ('dr', 'prof', 'mr', 'mrs', 'ms', 'sir', 'president', 'author', 'creator', 'founder', 'ceo', 'cto') AND capital THEN 'Person' END,
              CASE WHEN lag(normal) OVER w IN ('dr', 'prof', 'mr', 'mrs', 'ms', 'sir', 'president', 'author', 'creator', 'founder', 'ceo', 'cto') AND capital THEN 'ProperNoun' END,
              CASE WHEN capital AND lead(normal) OVER w IN ('inc', 'corp', 'llc', 'ltd', 'foundation', 'group', 'lab', 'labs', 'team', 'institute', 'consortium', 'association', 'dao') THEN 'Organization' END,
              CASE WHEN capital AND lead(normal) OVER w IN ('inc', 'corp', 'llc', 'ltd', 'foundation', 'group', 'lab', 'labs', 'team', 'institute', 'consortium', 'association', 'dao') THEN 'ProperNoun' END,
              CASE WHEN regexp_matches(token, '^[A-Z][a-z0-9]+[A-Z][a-zA-Z0-9]+$') THEN 'TechnicalTerm' END, CASE WHEN regexp_matches(token, '^[A-Z][a-z0-9]+[A-Z][a-zA-Z0-9]+$') THEN 'ProperNoun' END], lambda x: x IS NOT NULL)) AS tags
          FROM g WINDOW w AS (PARTITION BY doc_id, sentence ORDER BY i)
        )"""
ORACLES = {
    # Row by row: what is used so far decides whether the next text fits.
    "budgeted_texts": """
        WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 0 ELSE length(coalesce(text, '')) // 40 END AS tokens, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
        w(n, doc_id, tokens, is_full, used) AS (
          SELECT n, doc_id, tokens, tokens <= 3000, CASE WHEN tokens <= 3000 THEN tokens ELSE 50 END FROM d WHERE n = 1
          UNION ALL SELECT d.n, d.doc_id, d.tokens, w.used + d.tokens <= 3000, w.used + CASE WHEN w.used + d.tokens <= 3000 THEN d.tokens WHEN d.tokens = 0 THEN 0 ELSE 50 END FROM w JOIN d ON d.n = w.n + 1
        ) SELECT doc_id, tokens, is_full AS "full" FROM w""",
    "contextual_tags": f"{_TOKENS_TAGGED} SELECT doc_id, tag, count(*) AS n FROM (SELECT doc_id, unnest(tags) AS tag FROM c) GROUP BY doc_id, tag",
    "tagged_phrases": f"""{_TOKENS_TAGGED}, v AS (SELECT *, len(list_intersect(tags, ['ProperNoun', 'TechnicalTerm', 'Noun', 'Acronym'])) > 0 AND NOT stop AS salient FROM c),
        r AS (SELECT doc_id, sentence, i, token, i - row_number() OVER (PARTITION BY doc_id, sentence ORDER BY i) AS run FROM v WHERE salient),
        p AS (SELECT doc_id, sentence, run, string_agg(token, ' ' ORDER BY i) AS phrase FROM r GROUP BY ALL HAVING count(*) >= 2)
        SELECT doc_id, phrase, count(*) AS n FROM p GROUP BY doc_id, phrase""",
    # A later kind takes a name over and leaves it its place; an acronym takes none over. Patterns and the stop words that occur are written out.
    "pattern_entities": rf"""
        WITH d AS ({PATTERNED}), k AS (
          SELECT id, 1 AS kind, generate_subscripts(m, 1) AS pos, unnest(m) AS name FROM (SELECT id, regexp_extract_all(text, '\b([a-z]+[A-Z][a-zA-Z0-9]*|[A-Z][a-zA-Z0-9]+[A-Z][a-zA-Z0-9]*|[a-zA-Z0-9]+_[a-zA-Z0-9_]+|[A-Z]{{2,}}_[A-Z0-9_]+)\b', 1) AS m FROM d)
          UNION ALL SELECT id, 2, generate_subscripts(m, 1), unnest(m) FROM (SELECT id, regexp_extract_all(text, '(?i)\b(OAuth(?:\s*2\.0)?|JWT|REST(?:ful)?|GraphQL|gRPC|HTTP[S]?|SQL|PostgreSQL|MySQL|SQLite|NoSQL|JSON|YAML|XML|API|SDK|SDKs|CLI|TCP|UDP|IP|DNS|SSL|TLS|Docker|Kubernetes|HTML|CSS|TypeScript|JavaScript|Python|Rust|Go|C\+\+|AWS|GCP|Azure|Firebase|Firestore|Markdown|OKF)\b', 1) AS m FROM d)
          UNION ALL SELECT id, 3, generate_subscripts(m, 1), unnest(m) FROM (SELECT id, regexp_extract_all(text, '\b([A-Z]{{3,5}})\b', 1) AS m FROM d)
          UNION ALL SELECT id, 4, generate_subscripts(m, 1), unnest(m) FROM (SELECT id, regexp_extract_all(text, '(?i)\b(\d+(?:\.\d+)?\s*(?:%|ms|seconds?|mins?|hours?|req/s|rps|KB|MB|GB|TB|kps|fps|tokens?))\b', 1) AS m FROM d)
          UNION ALL SELECT id, 5, generate_subscripts(m, 1), trim(unnest(m)) FROM (SELECT id, regexp_extract_all(text, '`([^`\n]+)`', 1) AS m FROM d)
        ), f AS (
          SELECT *, kind * 100000 + pos AS ord FROM k WHERE CASE kind WHEN 1 THEN length(name) >= 3 AND lower(name) NOT IN ('the', 'and') WHEN 3 THEN lower(name) NOT IN ('the', 'and') WHEN 5 THEN length(name) BETWEEN 2 AND 40 AND lower(name) NOT IN ('the', 'and') ELSE true END
        ), g AS (
          SELECT id, name, min(ord) AS ord, max(CASE kind WHEN 3 THEN 0 ELSE kind END) AS kind FROM f GROUP BY id, name
        ), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS place FROM g)
        SELECT id, place, name AS text, CASE kind WHEN 0 THEN 'technical' WHEN 2 THEN 'protocol' WHEN 4 THEN 'metric' ELSE 'code' END AS category,
          CASE kind WHEN 0 THEN 0.85 WHEN 1 THEN 0.95 WHEN 2 THEN 0.98 ELSE 0.9 END::DOUBLE AS confidence FROM r WHERE place <= 20""",
    "doc_stats": rf"""
        SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, {_N('\\S+').replace(chr(92) * 2, chr(92))} AS words,
          CAST(greatest(1, ceil(len(regexp_extract_all(text, '\S+')) / 200)) AS BIGINT) AS reading_minutes,
          {_N('(?m)^#[ \t\n\f\r]+')} AS h1, {_N('(?m)^##[ \t\n\f\r]+')} AS h2, {_N('(?m)^###[ \t\n\f\r]+')} AS h3, {_N('(?m)^####+[ \t\n\f\r]+')} AS deeper,
          CAST(floor(len(regexp_extract_all(text, '(?m)^```')) / 2) AS BIGINT) AS code_blocks, {_N('`[^`\n]+`')} AS inline_code,
          len(regexp_extract_all(text, '!\[.*?\]\(.*?\)')) AS images,
          CAST(greatest(0, len(regexp_extract_all(text, '\[.*?\]\(.*?\)')) - len(regexp_extract_all(text, '!\[.*?\]\(.*?\)'))) AS BIGINT) AS links,
          len(regexp_extract_all(text, '(?m)^\s*[-*+]\s+')) AS bullets, len(regexp_extract_all(text, '(?m)^\s*\d+\.\s+')) AS numbered,
          CAST(greatest(1, len(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:[#|*+-]|```|\d+\.)')))) AS BIGINT) AS paragraphs,
          CAST(floor(len(regexp_extract_all(text, '\$\$')) / 2) + len(regexp_extract_all(text, '\$[^\$\n]+\$')) AS BIGINT) AS formulas,
          CAST(CASE WHEN len(regexp_extract_all(text, '\S+')) = 0 THEN 0 ELSE greatest(1, least(18, floor(0.39e0 * (len(regexp_extract_all(text, '\S+')) / greatest(1, len(regexp_extract_all(text, '[.!?]+(?:\s|$)')))) + 11.8e0 * 1.35e0 - 15.59e0 + 0.5e0))) END AS BIGINT) AS grade
        FROM documents""",
    "token_estimates": r"""
        WITH d AS (SELECT doc_id, text, length(text) AS n, len(regexp_extract_all(text, '\S+')) AS w,
            len(regexp_extract_all(text, '[!@#$%^&*()_+={}\[\]:;"''<>,.?/\\|`~-]')) AS m, length(array_to_string(regexp_extract_all(text, '(?s)```.*?```'), '')) AS code FROM documents)
        SELECT doc_id, CAST(ceil(n / 4) AS BIGINT) AS chars_up, CAST(floor(n / 4 + 0.5) AS BIGINT) AS chars_near, CAST(ceil(w * 1.35e0) AS BIGINT) AS words_up, CAST(floor(w * 1.33e0 + 0.5e0) AS BIGINT) AS words_near,
          CAST(CASE WHEN n > 0 THEN greatest(1, floor(ceil(n / CASE WHEN code / n > 0.4 THEN 3.2e0 ELSE 3.8e0 END) * 0.4e0 + ceil(w * 1.28e0 + m * 0.45e0) * 0.6e0 + 0.5e0)) ELSE 0 END AS BIGINT) AS estimate FROM d""",
    "readability": rf"""
        WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '`[^`]+`', '', 'g') AS t FROM documents),
        w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS ws FROM c),
        n AS (SELECT doc_id, greatest(1, len(ws)) AS nw, greatest(1, len(list_filter(string_split_regex(t, '[.!?]+(?:\s+|$)'), lambda s: length(regexp_replace(s, '^\s+|\s+$', '', 'g')) > 3))) AS ns, coalesce(list_sum(list_transform(ws, lambda w: {_SYLLABLES})), 0) AS sy FROM w),
        r AS (SELECT *, CAST(greatest(0, least(100, floor(206.835e0 - 1.015e0 * (nw / ns) - 84.6e0 * (sy / nw) + 0.5))) AS BIGINT) AS flesch FROM n)
        SELECT doc_id, nw AS word_count, ns AS sentence_count, flesch, CAST(greatest(1, floor(0.39e0 * (nw / ns) + 11.8e0 * (sy / nw) - 15.59e0 + 0.5)) AS BIGINT) AS grade,
          CASE WHEN flesch >= 70 THEN 'Simple' WHEN flesch >= 50 THEN 'Standard' WHEN flesch >= 30 THEN 'Technical' ELSE 'Advanced' END AS label FROM r""",
    "content_quality": rf"""
        WITH q AS (SELECT doc_id, text, {_VAGUE} AS found, len({_VAGUE_LIST}) AS kinds, greatest(1, len(string_split_regex(text, '\s+'))) AS w, {_STEPS} AS s, {_CODE} AS c, {_TABLE} AS t,
            regexp_matches(text, '(?i)\b\d+(?:\.\d+)?\s*(?:%|ms|seconds?|req/s|MB|GB|KB)\b') AS m FROM documents)
        SELECT doc_id, least(1.0e0, floor(found / (w / 30) * 100 + 0.5) / 100) AS ambiguity, CAST(kinds AS BIGINT) AS n_vague, s AS has_steps, c AS has_code, t AS has_table, m AS has_metrics,
          CAST(greatest(10, least(100, 70 + CASE WHEN length(text) > 200 THEN 10 ELSE 0 END + CASE WHEN c OR t OR s THEN 10 ELSE 0 END + CASE WHEN kinds = 0 THEN 10 ELSE -least(25, kinds * 5) END)) AS BIGINT) AS completeness FROM q""",
    "types_and_slugs": rf"""
        SELECT doc_id,
          CASE WHEN {_TABLE} AND {_HAS('table', 'schema', 'matrix', 'data')} THEN 'table'
            WHEN {_HAS('how to', 'procedure', 'workflow', 'guide', 'steps', 'installation')} OR (len(regexp_extract_all(text, '(?im)^\s*(?:\d+\.|\bstep\s*\d+:)')) >= 2 AND len(regexp_extract_all(text, '(?i)\b(?:install|configure|run|execute|create|set up|download|click|navigate|open|deploy)\b')) >= 2) THEN 'procedure'
            WHEN {_HAS('metric', 'kpi', 'benchmark', 'latency', 'performance', 'stat', 'sla')} THEN 'metric'
            WHEN {_HAS('guideline', 'rule', 'policy', 'standard', 'compliance')} OR regexp_matches(text, '(?i)\b(?:must|shall|mandatory|prohibited|forbidden|required to)\b') THEN 'guideline'
            WHEN {_HAS('api', 'reference', 'spec', 'glossary', 'dictionary')} OR regexp_matches(text, '\b(?:GET|POST|PUT|DELETE|PATCH)\s+/api/') THEN 'reference' ELSE 'concept' END AS concept_type,
          CASE WHEN {_HAS('how to', 'procedure', 'guide', 'steps', 'workflow', 'setup', 'installation')} OR regexp_matches(text, '(?m)^\s*1\.\s+') THEN 'procedure'
            WHEN {_HAS('table', 'data', 'sheet', 'matrix', 'schema')} OR {_TABLE} THEN 'table' WHEN {_HAS('metric', 'benchmark', 'kpi', 'stat', 'score')} THEN 'metric'
            WHEN {_HAS('policy', 'rule', 'guideline', 'standard', 'compliance')} THEN 'guideline' WHEN {_HAS('api', 'reference', 'spec', 'dictionary', 'glossary')} THEN 'reference' ELSE 'concept' END AS section_type,
          CASE WHEN trim(regexp_replace(lower({_TITLE}), '[^\w\s-]', '', 'g')) = '' THEN 'untitled-concept' ELSE substring(regexp_replace(trim(regexp_replace(lower({_TITLE}), '[^\w\s-]', '', 'g')), '\s+', '-', 'g'), 1, 60) END AS slug_words,
          CASE WHEN regexp_replace(regexp_replace(lower({_TITLE}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN 'unnamed' ELSE regexp_replace(regexp_replace(lower({_TITLE}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS slug_ascii,
          regexp_replace(lower({_TITLE}), '[^a-z0-9]+', '-', 'g') AS slug_section
        FROM documents""",
    "term_frequency": f"""
        WITH t AS (SELECT doc_id, {_TOKENS.format('text')} AS ts FROM documents), e AS (SELECT doc_id, len(ts) AS total, unnest(ts) AS term FROM t)
        SELECT doc_id, term, count(*) AS n, round(count(*) / total, 8) AS tf FROM e GROUP BY doc_id, term, total""",
    "term_idf": f"""
        WITH e AS (SELECT DISTINCT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents)
        SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1, 8) AS idf FROM e GROUP BY term""",
    "cosine_pairs": f"""
        WITH t AS (SELECT item_id AS id, {_TOKENS.format('text')} AS ts FROM benchmark), e AS (SELECT id, len(ts) AS total, unnest(ts) AS term FROM t),
        f AS (SELECT id, term, count(*) / total AS tf FROM e GROUP BY id, term, total), d AS (SELECT term, ln(((SELECT count(*) FROM benchmark) + 1) / (count(*) + 1)) + 1 AS idf FROM f GROUP BY term),
        v AS (SELECT id, term, tf * idf AS w FROM f JOIN d USING (term)), n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM v GROUP BY id),
        p AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS dot FROM v x JOIN v y ON x.term = y.term AND x.id < y.id GROUP BY 1, 2)
        SELECT a, b, round(dot / (na.norm * nb.norm), 6) AS cosine FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b""",
    "jaccard_pairs": f"""
        WITH e AS (SELECT DISTINCT item_id AS id, unnest({_TOKENS.format('text')}) AS item FROM benchmark), n AS (SELECT id, count(*) AS n FROM e GROUP BY id),
        p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM e x JOIN e y ON x.item = y.item AND x.id < y.id GROUP BY 1, 2)
        SELECT a, b, shared, round(shared / (na.n + nb.n - shared), 6) AS jaccard FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b""",
    "keyphrases": rf"""
        WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^`\n]+`', ' ', 'g') AS clean FROM documents),
        w AS (SELECT doc_id, {_TOKENS.format('clean')} AS one, list_filter(list_transform(string_split_regex(clean, '\s+'), lambda x: regexp_replace(lower(x), '[^\w-]', '', 'g')), lambda x: x <> '') AS bare, {_TOKENS.format(r"array_to_string(regexp_extract_all(clean, '\*\*[^*]+\*\*'), ' ')")} AS bold FROM c),
        p AS (SELECT doc_id, bare[i] AS a, bare[i + 1] AS b FROM (SELECT doc_id, bare, unnest(range(1, len(bare))) AS i FROM w)),
        e AS (SELECT doc_id, unnest(one) AS phrase, 1.0e0 AS x FROM w UNION ALL SELECT doc_id, a || '-' || b, 2.5e0 FROM p WHERE length(a) > 2 AND length(b) > 2 AND a NOT IN ({_WORDS}) AND b NOT IN ({_WORDS}) UNION ALL SELECT doc_id, unnest(list_distinct(list_filter(bold, lambda y: list_contains(one, y)))), 3.0e0 FROM w),
        s AS (SELECT doc_id, phrase, sum(x) AS weight FROM e WHERE length(phrase) >= 3 GROUP BY doc_id, phrase), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, phrase) AS rank FROM s)
        SELECT doc_id, rank, phrase, weight FROM r WHERE rank <= 8""",
    "tfidf_search": f"""
        WITH t AS (SELECT doc_id, {_TOKENS.format('text')} AS ts FROM documents), e AS (SELECT doc_id, len(ts) AS total, unnest(ts) AS term FROM t),
        f AS (SELECT doc_id, term, count(*) / total AS tf FROM e GROUP BY doc_id, term, total), q AS (SELECT term, count(*) / sum(count(*)) OVER () AS qtf FROM (SELECT unnest({_TOKENS.format(f"'{QUERY}'")}) AS term) GROUP BY term),
        b AS (SELECT term FROM f UNION ALL SELECT term FROM q), d AS (SELECT term, ln(((SELECT count(*) FROM documents) + 2) / (count(*) + 1)) + 1 AS idf FROM b GROUP BY term),
        qn AS (SELECT sqrt(sum((qtf * idf) ** 2)) AS qn FROM q JOIN d USING (term)), v AS (SELECT doc_id, tf * idf AS w, qtf * idf AS qw FROM f JOIN d USING (term) LEFT JOIN q USING (term))
        SELECT doc_id, round(sum(w * qw) / (sqrt(sum(w * w)) * (SELECT qn FROM qn)), 6) AS cosine FROM v GROUP BY doc_id HAVING sum(w * qw) > 0 ORDER BY cosine DESC, doc_id LIMIT 20""",
    "reading_figures": rf"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents),
        n AS (SELECT doc_id, len(ws) AS word_count, CASE WHEN len(ws) > 0 THEN greatest(1, len(regexp_extract_all(text, '[.!?]+(?:\s|$)'))) ELSE 0 END AS sentence_count, list_transform(ws, lambda w: {_SYLLABLES}) AS sy FROM w),
        c AS (SELECT doc_id, word_count, sentence_count, CAST(coalesce(list_sum(sy), 0) AS BIGINT) AS syllable_count, len(list_filter(sy, lambda x: x >= 3)) AS polysyllable_count FROM n),
        r AS (SELECT *, CASE WHEN word_count > 0 THEN 206.835e0 - 1.015e0 * (word_count / sentence_count) - 84.6e0 * (syllable_count / word_count) ELSE 0 END AS ease FROM c)
        SELECT doc_id, word_count, CAST(sentence_count AS BIGINT) AS sentence_count, syllable_count, CAST(polysyllable_count AS BIGINT) AS polysyllable_count, round(ease, 6) AS reading_ease,
          round(CASE WHEN word_count > 0 THEN 0.39e0 * (word_count / sentence_count) + 11.8e0 * (syllable_count / word_count) - 15.59e0 ELSE 0 END, 6) AS grade_level, round(CASE WHEN word_count > 0 THEN 1.043e0 * sqrt(polysyllable_count * 30e0 / sentence_count) + 3.1291e0 ELSE 0 END, 6) AS smog_index,
          CASE WHEN word_count = 0 THEN NULL WHEN ease >= 90 THEN 'very easy' WHEN ease >= 80 THEN 'easy' WHEN ease >= 70 THEN 'fairly easy' WHEN ease >= 60 THEN 'standard' WHEN ease >= 50 THEN 'fairly difficult' WHEN ease >= 30 THEN 'difficult' ELSE 'very difficult' END AS complexity FROM r""",
    "keywords": f"""
        WITH e AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents), n AS (SELECT doc_id, term, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, encode(term)) AS place FROM n)
        SELECT doc_id, string_agg(term, ' ' ORDER BY place) AS keywords FROM p WHERE place <= 12 GROUP BY doc_id""",
    "boosted_search": f"""
        WITH c AS (SELECT * FROM ({inputs.CONCEPTS}) x WHERE trust_tier = 'human-reviewed'), t AS (SELECT id, {_TOKENS.format("(title || ' ' || description || ' ' || body)")} AS ts FROM c), e AS (SELECT id, len(ts) AS total, unnest(ts) AS term FROM t),
        f AS (SELECT id, term, count(*) / total AS tf FROM e GROUP BY id, term, total), q AS (SELECT term, count(*) / sum(count(*)) OVER () AS qtf FROM (SELECT unnest({_TOKENS.format(f"'{ASKED}'")}) AS term) GROUP BY term),
        b AS (SELECT term FROM f UNION ALL SELECT term FROM q), d AS (SELECT term, ln(((SELECT count(*) FROM c) + 2) / (count(*) + 1)) + 1 AS idf FROM b GROUP BY term),
        qn AS (SELECT sqrt(sum((qtf * idf) ** 2)) AS qn FROM q JOIN d USING (term)), v AS (SELECT id, tf * idf AS w, qtf * idf AS qw FROM f JOIN d USING (term) LEFT JOIN q USING (term)),
        s AS (SELECT id, coalesce(sum(w * qw), 0) / (sqrt(sum(w * w)) * (SELECT qn FROM qn)) AS cosine FROM v GROUP BY id),
        z AS (SELECT id, coalesce(cosine, 0) AS cosine, CASE WHEN contains('{ASKED}', lower(title)) THEN 0.35e0 ELSE 0 END
          + list_sum(list_transform(['nation_1', 'procedure', 'region_2'], lambda w: CASE WHEN contains(lower(body), w) OR tag_a = w OR tag_b = w THEN 0.15e0 ELSE 0 END)) AS boost FROM c LEFT JOIN s USING (id))
        SELECT id, round(least(1.0e0, cosine + boost), 6) AS score FROM z WHERE least(1.0e0, cosine + boost) > 0.08 OR boost > 0 ORDER BY score DESC, id LIMIT 1000""",
    "keyword_search": f"""
        WITH c AS ({inputs.CONCEPTS}), s AS (SELECT id, 10 * CAST(contains(lower(title), 'nation_1') AS INT) + 5 * CAST(contains(lower(description), 'nation_1') AS INT) + 4 * CAST(contains(lower(tag_a), 'nation_1') OR contains(lower(tag_b), 'nation_1') AS INT) + 2 * CAST(contains(lower(concat_ws(' ', title, description, tag_a, tag_b, body)), 'nation_1') AS INT) AS score FROM c)
        SELECT id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 10""",
    "lexical_scores": f"""
        WITH c AS (SELECT id, lower(title) AS t, lower(tag_a || ' ' || tag_b) AS g, lower(description) AS d, lower(body) AS b FROM ({inputs.CONCEPTS}) x)
        SELECT id, round(list_sum(list_transform(['supplier', 'region', 'install'], lambda w: CASE WHEN contains(t, w) THEN 5.0 WHEN contains(g, w) THEN 3.0 WHEN contains(d, w) THEN 2.0 WHEN contains(b, w) THEN 0.5 ELSE 0.0 END))::DOUBLE / 15.0::DOUBLE, 6) AS score FROM c""",
    "rank_fusion": r"""
        WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY len(regexp_extract_all(text, '\S+')) DESC, doc_id) AS rank FROM documents)
        SELECT doc_id, round(sum(1.0e0 / (60 + rank)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id""",
    "dense_top_k": """
        WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
        SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)), 6) AS cosine FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)) DESC, vec_id LIMIT 10""",
    "lexicon_matches": f"""
        WITH c AS ({inputs.CONCEPTS}), m AS (SELECT c.id AS doc_id, n_name AS name, len(regexp_extract_all(lower(body), '\\b' || lower(n_name) || '\\b')) AS occurrences FROM c JOIN nation ON contains(lower(body), lower(n_name)) WHERE n_nationkey <> 3)
        SELECT doc_id, name, CAST(occurrences AS BIGINT) AS occurrences, round(least(1.0e0, 0.5e0 + 0.05e0 * occurrences), 6) AS salience, lower(name) AS tag FROM m WHERE occurrences > 0""",
    "tag_cooccurrence": f"""
        WITH c AS ({inputs.CONCEPTS}), t AS (SELECT DISTINCT id, unnest([tag_a, tag_b, type]) AS tag FROM c)
        SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS weight FROM t x JOIN t y ON x.id = y.id AND x.tag < y.tag GROUP BY 1, 2""",
    "facets": f"SELECT tag, count(*) AS n FROM (SELECT unnest([tag_a, tag_b]) AS tag FROM ({inputs.CONCEPTS}) c) GROUP BY tag",
}

QUERIES = {f.__name__: f for f in (doc_stats, token_estimates, readability, content_quality, types_and_slugs, term_frequency, term_idf, cosine_pairs, jaccard_pairs, keyphrases, tfidf_search, reading_figures, keywords, boosted_search, keyword_search, lexical_scores, rank_fusion, dense_top_k, budgeted_texts, pattern_entities, noun_phrases, contextual_tags, tagged_phrases, lexicon_matches, tag_cooccurrence, facets)}
