"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import embedding_dedup, fill_middle, language_model, lexical_search, mixing, packing, pii, quality, secrets, token_files, topk, toxicity
from marlstone.llm.jaccard_join import jaccard_components
from marlstone.session import table


def op1_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64.0)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), percent=150, most_copies=2)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), unit="line", seed=7, rate=100, spm=50)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50, b=50)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, end_id=2)
    return token_files.read_token_files(spark, folder)


_ALL = (
    op1_exact_topk_search, op2_ngram_jaccard_join, op3_pii, op4_mixing, op5_secret_scan, op6_quality_classifier, op7_lm_scoring, op8_toxicity, op9_embedding_near_dedup, op10_packing,
    op11_fill_in_middle, op12_lexical_search, op13_token_files,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT query_id, vec_id, score,
                   row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n
            FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
    """,
    "op11_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                   regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines
            FROM documents
        ), c AS (
            SELECT doc_id, text, lines, len(lines) AS n,
                   CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(lines) + 1) AS a,
                   CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(lines) + 1) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                             OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
                        WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), p AS (
            SELECT doc_id, text, n, form,
                   array_to_string(lines[1 : least(a, b)], '') AS prefix,
                   array_to_string(lines[least(a, b) + 1 : greatest(a, b)], '') AS middle,
                   array_to_string(lines[greatest(a, b) + 1 :], '') AS suffix
            FROM c
        )
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                                WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
    "op12_lexical_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), kept AS (
            SELECT r, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0
        ), whole AS (
            SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM kept
        ), i AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark WHERE item_id IS NOT NULL
        ), words AS (
            SELECT r, doc_id, n, unnest(terms) AS term FROM kept
        ), p AS (
            SELECT r, doc_id, n, term, count(*) AS tf FROM words
            WHERE term IN (SELECT term FROM i) GROUP BY r, doc_id, n, term
        ), w AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
            FROM p CROSS JOIN whole GROUP BY term
        ), s AS (
            SELECT item_id, r, doc_id,
                   CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
            FROM p JOIN i USING (term) JOIN w USING (term) CROSS JOIN whole
            GROUP BY item_id, r, doc_id
        ), o AS (
            SELECT item_id, doc_id, score,
                   row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place
            FROM s WHERE score > 0
        )
        SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM o WHERE place <= 50
    """,
}
