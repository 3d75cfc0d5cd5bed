"""Inputs of the registered queries: concepts, links and Markdown texts made from the tables.

The statements are in the dialect that Spark and DuckDB share, so that both sides of a
comparison start from the same rows; what is compared comes after them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.session import table

CONCEPTS = """
SELECT 'c' || CAST(s_suppkey AS STRING) AS id,
       'n' || CAST(s_nationkey AS STRING) || '/c' || CAST(s_suppkey AS STRING) || '.md' AS path,
       s_name AS title, n_name AS tag_a, r_name AS tag_b,
       CASE s_suppkey % 5 WHEN 0 THEN 'procedure' WHEN 1 THEN 'guideline' WHEN 2 THEN 'table' WHEN 3 THEN 'metric' ELSE 'idea' END AS type,
       CASE s_suppkey % 3 WHEN 0 THEN 'human-reviewed' WHEN 1 THEN 'machine-confirmed' ELSE 'unverified' END AS trust_tier,
       CASE s_suppkey % 7 WHEN 0 THEN 'draft' WHEN 1 THEN 'old' ELSE 'stable' END AS status,
       CASE WHEN s_suppkey % 4 = 0 THEN 'none' ELSE 'A supplier of ' || n_name || ' in ' || r_name END AS description,
       CASE WHEN s_suppkey % 6 = 0 THEN 'reviewer' ELSE '' END AS verified,
       CASE s_suppkey % 5 WHEN 0 THEN '2024-01-31' WHEN 1 THEN 'soon' ELSE '2030-06-30' END AS stale_after,
       CASE WHEN s_suppkey % 8 = 0 THEN 'sum' ELSE '' END AS computation,
       CASE WHEN s_suppkey % 16 = 0 THEN 'sql' ELSE '' END AS runtime,
       s_name || ' must ship from ' || n_name || '.' || CASE WHEN s_suppkey % 2 = 0 THEN chr(10) || '1. Install the label' ELSE '' END AS body
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
LINKS = """
SELECT 'c' || CAST(s_suppkey AS STRING) AS src, 'c' || CAST((s_suppkey * 7 + 1) % (SELECT count(*) FROM supplier) AS STRING) AS dst, 'depends_on' AS kind
FROM supplier WHERE s_suppkey % 4 <> 3
UNION ALL
SELECT 'c' || CAST(s_suppkey AS STRING), 'c' || CAST((s_suppkey * 3 + 2) % (SELECT count(*) + 9 FROM supplier) AS STRING), 'references'
FROM supplier WHERE s_suppkey % 3 <> 0
"""
EDGES = f"""
SELECT DISTINCT src, dst, kind FROM ({LINKS}) l
WHERE src <> dst AND dst IN (SELECT 'c' || CAST(s_suppkey AS STRING) FROM supplier)
"""
#: A document for each nation: headings, prose, links inside and outside fences.
MARKDOWN = """
SELECT n_nationkey AS doc_id,
       'Before any heading.' || chr(10) || '# ' || n_name || chr(10) || 'In [[' || r_name || ']] and [[c' || CAST(n_nationkey AS STRING) || '|the supplier]].' || chr(10) ||
       '## Steps' || chr(10) || 'See [page](https://example.com/' || CAST(n_nationkey AS STRING) || ') and [near](../n' || CAST(n_nationkey AS STRING) || '.md), not `[[code]]`.' || chr(10) ||
       '```sql' || chr(10) || '# not a heading' || chr(10) || 'select [[no]] from t' || chr(10) || '```' || chr(10) ||
       CASE WHEN n_nationkey % 2 = 0 THEN '### Deep ' || r_name || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) ELSE '' END ||
       '## Data table' || chr(10) || 'Last of ' || n_name || '.' AS text
FROM nation JOIN region ON n_regionkey = r_regionkey
"""


def sql(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """Run a shared statement over the tables below ``sf_dir``."""
    for name in ("region", "nation", "supplier"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(statement)


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sql(spark, sf_dir, CONCEPTS)
    return df.selectExpr("*", "array(tag_a, tag_b) AS tags")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, EDGES)


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, MARKDOWN)
