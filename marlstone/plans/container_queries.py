"""Registered queries of typed blocks and their container styles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import containers
from marlstone.plans import inputs
from marlstone.session import durable, table
from marlstone.sources import provenance

#: Every document under headings, some with a header, with a fence and a table after its text.
ARTICLES = """
SELECT doc_id,
  CASE WHEN doc_id % 3 = 0 THEN '---' || chr(10) || 'title: "Paper: ' || CAST(doc_id AS STRING) || '"' || chr(10) || 'author: Ann' || chr(10) || 'tags: [law, t' || CAST(doc_id % 4 AS STRING) || ']' || chr(10) || '---' || chr(10) ELSE '' END ||
  CASE WHEN doc_id % 2 = 0 THEN '# Overview of ' || CAST(doc_id AS STRING) || chr(10) || 'See [[Term ' || CAST(doc_id % 5 AS STRING) || ']] and **Lead Time** #stock' || chr(10) ELSE 'Before any heading.' || chr(10) END ||
  coalesce(text, '') || chr(10) || '## Usage' || chr(10) || '1. Read it' || chr(10) || '```sql' || chr(10) || '# not a heading' || chr(10) || ':::note' || chr(10) || 'select ' || CAST(doc_id AS STRING) || chr(10) || '```' || chr(10) || 'After the fence.' || chr(10) ||
  '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | ' || CAST(doc_id AS STRING) || ' |' || chr(10) || '### ' || CASE doc_id % 4 WHEN 0 THEN 'FAQ' WHEN 1 THEN 'A "quoted" note' WHEN 2 THEN 'Sources' ELSE 'Rest' END || chr(10) || 'Last words.' AS text
FROM documents
"""


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(ARTICLES)


def okf_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = containers.metadata(_articles(spark, sf_dir))
    return found.select("doc_id", "title", "description", F.array_join("tags", ",").alias("tags"), "author", F.array_join("entities", ",").alias("entities"))


def container_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of every document, written in each style and read back."""
    # Written once: the blocks and the three styles all start from it.
    meta = durable(containers.metadata(_articles(spark, sf_dir)))
    cut = durable(containers.blocks(meta))
    texts = [containers.container_documents(meta, cut, "2026-01-31", s) for s in containers.STYLES]
    read = containers.container_blocks(reduce(DataFrame.unionAll, texts))
    return read.select("style", "doc_id", "ord", "block_id", "type", "title", F.md5("content").alias("content"), "language")


def export_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the suppliers' bundle, by what their JSON says."""
    c = inputs.concepts(spark, sf_dir)
    sources = F.when(F.col("computation") != "", F.array(F.concat("tag_a", F.lit(" atlas (1)")), F.lit("x/y")))
    nodes = provenance.provenance_nodes(c.withColumn("attester", F.col("verified")).withColumn("sources", sources), inputs.edges(spark, sf_dir), "Suppliers Q1", "2026-01-31T00:00:00Z")
    at = lambda path: F.get_json_object("json", path)
    says = {
        "label": "$.prefLabel", "definition": "$.definition", "tier": "$.trustTier", "tags": "$.altLabel", "broader": "$.broader", "related": "$.related", "top_of": "$.topConceptOf", "top": "$.hasTopConcept", "made_by": "$.wasGeneratedBy",
        "made_at": "$.generatedAtTime", "agent": "$['prov:wasAssociatedWith']['@id']", "used": "$['prov:used']", "titled": "$['dc:title']", "version": "$['owl:versionInfo']",
    }
    return nodes.select("node", "kind", *(at(p).alias(n) for n, p in says.items()))


# The body below the header, and fields of the header, for both statements.
_HEAD = r"""h AS (SELECT doc_id, regexp_extract(text, '(?s)^---\n(.*?\n)---\n', 1) AS head, regexp_replace(text, '(?s)^---\n.*?\n---\n', '') AS body FROM a),
        b AS (SELECT *, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^[A-Z0-9].{20,180}\.') AND NOT regexp_matches(x, '^\d+\.'))[1] AS line FROM h),
        m AS (SELECT *, coalesce(nullif(trim(regexp_extract(head, '(?m)^title: "(.*)"$', 1)), ''), nullif(regexp_replace(regexp_extract(body, '(?m)^#\s+(.+)$', 1), '^\s+|\s+$', '', 'g'), ''), 'Untitled Knowledge Document') AS title FROM b),
        d AS (SELECT *, coalesce(regexp_extract(line, '^[A-Z0-9].{20,180}\.', 0), 'OKF Knowledge representation for ' || title) AS description FROM m)"""
_TAGS = r"list_concat(CASE WHEN head <> '' THEN string_split(regexp_extract(head, 'tags: \[(.*)\]', 1), ', ') ELSE [] END, regexp_extract_all(body, '(?:^|\s)#([a-zA-Z0-9_-]{3,20})', 1))"
_NAMES = r"list_transform(list_concat(regexp_extract_all(body, '\[\[([^\]]+)\]\]', 1), regexp_extract_all(body, '\*\*([A-\[Z][a-zA-Z0-9\s-]{2,30})\*\*', 1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"
_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
ORACLES = {
    "okf_metadata": f"""
        WITH a AS ({ARTICLES}), {_HEAD}, t AS (SELECT *, {_TAGS} AS tags, {_NAMES} AS names FROM d)
        SELECT doc_id, title, description, CASE WHEN len(tags) = 0 THEN 'knowledge,okf,markdown' ELSE array_to_string({_ONCE.format('tags')}, ',') END AS tags,
          CASE WHEN head <> '' THEN 'Ann' ELSE 'AI Studio OKF Engine' END AS author, coalesce(array_to_string(({_ONCE.format('names')})[1:15], ','), '') AS entities FROM t""",
    "container_blocks": rf"""
        WITH a AS ({ARTICLES}), {_HEAD},
        s AS (SELECT doc_id, string_split(regexp_replace(body, '(?m)(^#{{1,6}}\s+.+$|```[\s\S]*?```|^\|.+\|\n\|[-:\s|]+\|\n(?:\|.+\|\n?)*)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts FROM d),
        p AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS at_, regexp_replace(unnest(parts), '^\s+|\s+$', '', 'g') AS piece FROM s),
        g AS (SELECT *, regexp_matches(piece, '^#{{1,6}}\s') AS is_heading, last_value(CASE WHEN regexp_matches(piece, '^#{{1,6}}\s') THEN regexp_replace(piece, '^#{{1,6}}\s+', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY at_ ROWS UNBOUNDED PRECEDING) AS heading FROM p WHERE piece <> ''),
        k AS (SELECT doc_id, at_, heading, lower(heading) AS low, piece, piece LIKE '```%' AS code, piece LIKE '|%' AS tab, string_split(piece, chr(10)) AS ls FROM g WHERE NOT is_heading),
        f AS (
          SELECT doc_id, at_, CASE WHEN code THEN 'code' WHEN tab THEN 'table' WHEN regexp_matches(low, 'summary|overview|abstract') THEN 'summary' WHEN regexp_matches(low, 'concept|definition|architecture|theory') THEN 'concept'
            WHEN regexp_matches(low, 'step|guide|usage|how to|procedure|installation') THEN 'procedure' WHEN regexp_matches(low, 'note|warning|tip|caution') THEN 'note' WHEN regexp_matches(low, 'faq|question') THEN 'faq' WHEN regexp_matches(low, 'reference|link|source') THEN 'reference' ELSE 'content' END AS type,
            CASE WHEN code THEN coalesce('Code: ' || heading, 'Code Snippet') WHEN tab THEN coalesce('Data: ' || heading, 'Data Matrix') ELSE heading END AS title,
            CASE WHEN code THEN array_to_string(ls[2:len(ls) - 1], chr(10)) ELSE piece END AS content, CASE WHEN code THEN coalesce(nullif(trim(ls[1][4:]), ''), 'text') END AS language FROM k
          UNION ALL SELECT doc_id, 0, 'summary', 'Executive Summary', description, NULL FROM d),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY at_) AS ord FROM f)
        SELECT style, doc_id, ord, 'block-' || ord AS block_id, type, title, md5(content) AS content, language FROM o, (VALUES ('container'), ('comment'), ('attribute')) v(style)""",
    "export_provenance": f"""
        WITH c AS ({inputs.CONCEPTS}), e AS ({inputs.EDGES}), u AS (SELECT src, kind, 'urn:okf:concept:' || dst AS uri FROM e),
        l AS (SELECT src, '["' || string_agg(uri, '","' ORDER BY uri) FILTER (kind = 'depends_on') || '"]' AS broader, '["' || string_agg(uri, '","' ORDER BY uri) FILTER (kind = 'references') || '"]' AS related FROM u GROUP BY src),
        t AS (SELECT id FROM c WHERE id NOT IN (SELECT dst FROM e)),
        m AS (SELECT *, 'urn:okf:activity:' || id || ':generation' AS activity FROM c WHERE verified <> '' OR computation <> '')
        SELECT 'urn:okf:scheme:suppliers-q1' AS node, 'scheme' AS kind, NULL AS label, NULL AS definition, NULL AS tier, NULL AS tags, NULL AS broader, NULL AS related, NULL AS top_of, NULL AS top, NULL AS made_by, NULL AS made_at, NULL AS agent, NULL AS used, 'Suppliers Q1' AS titled, '0.2.0' AS version
        UNION ALL SELECT 'urn:okf:scheme:suppliers-q1', 'top', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'urn:okf:concept:' || id, NULL, NULL, NULL, NULL, NULL, NULL FROM t
        UNION ALL SELECT 'urn:okf:concept:' || c.id, 'concept', c.title, c.description, c.trust_tier, '["' || c.tag_a || '","' || c.tag_b || '"]', broader, related, CASE WHEN t.id IS NOT NULL THEN 'urn:okf:scheme:suppliers-q1' END, NULL, activity, NULL, NULL, NULL, NULL, NULL
          FROM c LEFT JOIN l ON l.src = c.id LEFT JOIN t ON t.id = c.id LEFT JOIN m ON m.id = c.id
        UNION ALL SELECT activity, 'activity', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '2026-01-31T00:00:00Z', CASE WHEN verified <> '' THEN 'urn:okf:attester:reviewer' ELSE 'urn:okf:agent:okf-engine' END,
          CASE WHEN computation <> '' THEN '["urn:okf:source:' || tag_a || '%20atlas%20(1)","urn:okf:source:x%2Fy"]' END, NULL, NULL FROM m""",
}
QUERIES = {f.__name__: f for f in (okf_metadata, container_blocks, export_provenance)}
