"""Registered queries of catalogs, entities and whole bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import catalog, entities, markdown
from marlstone.plans import inputs, rule_queries
from marlstone.session import table
from marlstone.sources import sinks

_ENTITY_TEXT = """
SELECT n_nationkey AS doc_id, 'In ' || lower(n_name) || ' the jwt of ada lovelace meets `fetch_rows` and ACME ' || CASE WHEN n_nationkey % 2 = 0 THEN 'and grpc, then grpc again.' ELSE 'only.' END AS text FROM nation
"""


def filtered_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.filtered(inputs.concepts(spark, sf_dir), " NATION_1 ", status="stable", tags="all").select("id", "status")


def selected_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.concepts(spark, sf_dir).select("id", "type")
    some = catalog.selected(c, c.where("type = 'procedure'").select("id").unionAll(spark.createDataFrame([("gone",)], "id string")))
    return some.withColumn("way", F.lit("some")).unionAll(catalog.selected(c, spark.createDataFrame([("gone",)], "id string")).withColumn("way", F.lit("none left")))


def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*(F.lit(s) for s in ("success", "error", "pending", "converting_markdown", "formatting_okf", "success", "success"))), (F.col("event_id") % 7 + 1).cast("int"))
    return catalog.queue_status(table(spark, sf_dir, "events").select(status.alias("status")))


def crawl_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", T.word_count(F.col("text")).alias("words"), (F.col("doc_id") % 5).alias("depth"))
    return catalog.crawl_totals(d, F.col("source"))


def skill_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = rule_queries._sql(spark, sf_dir, rule_queries.SKILLS, "supplier", "nation")
    return catalog.activation(skills, "shipping orders from NATION_1 now")


def carried_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.carried_tails(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text"), 40).select("conv_id", "turn", "context")


def extracted_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rule_queries._sql(spark, sf_dir, _ENTITY_TEXT, "nation")
    lexicon = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"), F.expr("cast(array() as array<string>)").alias("aliases"), F.lit("place").alias("category"), F.lit(0.5).alias("salience"), (F.col("n_nationkey") % 3 != 0).alias("enabled"))
    known = lambda *rows: spark.createDataFrame(list(rows), "key string, name string, category string")
    return entities.extracted_entities(docs, lexicon, known(("ada lovelace", "Ada Lovelace", "person")), known(("acme", "ACME Corp", "organization")), known(("grpc", "gRPC", "protocol"), ("jwt", "JWT", "protocol")))


def bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.bundle_files(inputs.markdown(spark, sf_dir))


def vector_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.vector_payload(markdown.chunks(inputs.markdown(spark, sf_dir), most_tokens=40, flush_tokens=10), "nations")


def lexicon_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    entries = n.select(
        F.col("n_name").alias("name"), F.concat(F.lit("land, "), "n_name").alias("category"), F.array(F.lower("n_name"), F.lit("a")).alias("aliases"), F.when(k % 3 == 1, 0.5).when(k % 3 == 2, 1.0).alias("salience"),
        F.when(k % 2 == 0, F.concat(F.lit('a "'), "n_name", F.lit('"'))).alias("description"), F.when(k % 5 == 0, False).when(k % 5 == 1, True).alias("enabled"),
    )
    return sinks.lexicon_csv(entries)


def export_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.tool_resources(inputs.concepts(spark, sf_dir))


def carried_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return catalog.carried_lines(pages, "source", "doc_id", F.col("text"), 3).select("doc_id", "context")


def unselected_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.concepts(spark, sf_dir)
    return catalog.unselected(c, c.where("type = 'procedure'").select("id")).select("id")


def tag_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.concepts(spark, sf_dir)
    return c.select("id", F.array_join(catalog.tag_union(F.col("tags"), F.array("type", "tag_a", "status"), 4), ",").alias("tags"))


def provenance_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.concepts(spark, sf_dir).select(F.when(F.col("verified") != "", F.array("verified", "title", "status")).otherwise(F.expr("cast(array() as array<string>)")).alias("sources"))
    return c.agg(catalog.provenance_total(F.col("sources")).alias("n_sources"))


def edge_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.edge_titles(inputs.sql(spark, sf_dir, inputs.LINKS), inputs.concepts(spark, sf_dir))


def shown_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.shown_edges(inputs.sql(spark, sf_dir, inputs.LINKS), inputs.concepts(spark, sf_dir), ("depends_on",), ("procedure", "guideline", "table"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.neighbours(inputs.concepts(spark, sf_dir), inputs.edges(spark, sf_dir))
    return found.select("id", F.array_join("prerequisites", ",").alias("prerequisites"), F.array_join("related", ",").alias("related"))


def top_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, e = inputs.concepts(spark, sf_dir), inputs.edges(spark, sf_dir)
    every = c.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return catalog.top_concepts(c, e).withColumn("way", F.lit("own")).unionAll(catalog.top_concepts(c, every).withColumn("way", F.lit("fallback")))


def bundle_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.bundle_issues(inputs.concepts(spark, sf_dir), inputs.sql(spark, sf_dir, inputs.LINKS), "2026-01-01").groupBy("id", "code", "severity").agg(F.count("*").alias("n"))


def analysed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 40).alias("title"), "text")
    return catalog.analysed(d).withColumn("tags", F.array_join("tags", ","))


def type_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.concepts(spark, sf_dir).groupBy("type", "status").agg(F.count("*").alias("n"))


def export_skos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.skos(inputs.concepts(spark, sf_dir), inputs.edges(spark, sf_dir))


_C, _E, _L = inputs.CONCEPTS, inputs.EDGES, inputs.LINKS
ORACLES = {
    "carried_lines": "SELECT doc_id, coalesce(array_to_string(list_reverse(list_reverse(string_split(lag(text) OVER (PARTITION BY source ORDER BY doc_id), chr(10)))[1:3]), chr(10)), '') AS context FROM documents",
    "unselected_concepts": f"SELECT id FROM ({_C}) c WHERE type <> 'procedure'",
    "tag_unions": f"SELECT id, array_to_string(list_filter([tag_a, CASE WHEN tag_b <> tag_a THEN tag_b END, CASE WHEN type NOT IN (tag_a, tag_b) THEN type END, CASE WHEN status NOT IN (tag_a, tag_b, type) THEN status END], lambda x: x IS NOT NULL), ',') AS tags FROM ({_C}) c",
    "provenance_total": f"SELECT CAST(sum(CASE WHEN verified <> '' THEN 3 ELSE 1 END) AS BIGINT) AS n_sources FROM ({_C}) c",
    "edge_titles": f"SELECT l.src, l.dst, l.kind, coalesce(a.title, l.src) AS src_title, coalesce(b.title, l.dst) AS dst_title FROM ({_L}) l LEFT JOIN ({_C}) a ON a.id = l.src LEFT JOIN ({_C}) b ON b.id = l.dst",
    "shown_edges": f"SELECT l.src, l.dst, l.kind FROM ({_L}) l JOIN ({_C}) a ON a.id = l.src JOIN ({_C}) b ON b.id = l.dst WHERE l.kind = 'depends_on' AND a.type IN ('procedure', 'guideline', 'table') AND b.type IN ('procedure', 'guideline', 'table')",
    "neighbours": f"SELECT c.id, coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM ({_E}) e WHERE e.src = c.id AND kind = 'depends_on'), '') AS prerequisites, coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM ({_E}) e WHERE e.src = c.id AND kind <> 'depends_on'), '') AS related FROM ({_C}) c",
    "top_concepts": f"WITH o AS (SELECT id FROM ({_C}) c WHERE id NOT IN (SELECT dst FROM ({_E}) e)) SELECT id, 'own' AS way FROM o UNION ALL SELECT min(id), 'own' FROM ({_C}) c WHERE NOT EXISTS (SELECT 1 FROM o) HAVING min(id) IS NOT NULL UNION ALL SELECT min(id), 'fallback' FROM ({_C}) c",
    "bundle_issues": f"""
        WITH RECURSIVE c AS ({_C}), l AS ({_L}), i AS (SELECT id, unnest([
            CASE WHEN lower(type) NOT IN ('concept', 'procedure', 'table', 'metric', 'guideline', 'reference', 'architecture', 'model') THEN 'WARN_UNKNOWN_TYPE' END, CASE WHEN length(trim(description)) < 10 THEN 'INFO_SHORT_DESCRIPTION' END, CASE WHEN type = 'procedure' AND NOT regexp_matches(body, '(?m)^\\s*1\\.\\s+') THEN 'WARN_PROCEDURE_WITHOUT_STEPS' END,
            CASE WHEN trust_tier = 'human-reviewed' AND verified = '' THEN 'WARN_UNVERIFIED_HUMAN_CLAIM' END, CASE WHEN try_cast(stale_after AS DATE) IS NULL THEN 'ERR_INVALID_DATE_FORMAT' END, CASE WHEN try_cast(stale_after AS DATE) < DATE '2026-01-01' THEN 'WARN_CONCEPT_STALE' END,
            CASE WHEN status NOT IN ('draft', 'stable', 'deprecated') THEN 'WARN_UNKNOWN_STATUS' END, CASE WHEN computation <> '' AND runtime = '' THEN 'WARN_MISSING_COMPUTATION_RUNTIME' END]) AS code FROM c),
          d AS (SELECT DISTINCT src, dst FROM l WHERE kind = 'depends_on' AND dst IN (SELECT id FROM c)), r(a, b) AS (SELECT src, dst FROM d UNION SELECT r.a, d.dst FROM r JOIN d ON d.src = r.b),
          j AS (SELECT id, code FROM i WHERE code IS NOT NULL UNION ALL SELECT src, 'WARN_BROKEN_LINK' FROM l WHERE dst NOT IN (SELECT id FROM c) UNION ALL SELECT DISTINCT a, 'ERR_DEPENDENCY_CYCLE' FROM r WHERE a = b UNION ALL SELECT id, 'ERR_DUPLICATE_PATH' FROM c WHERE path IN (SELECT path FROM c GROUP BY path HAVING count(*) > 1))
        SELECT id, code, CASE WHEN code LIKE 'ERR%' THEN 'error' WHEN code LIKE 'WARN%' THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM j GROUP BY id, code""",
    "export_skos": f"""
        WITH c AS ({_C}), e AS ({_E}), u AS (SELECT c.*, (SELECT string_agg('"urn:okf:concept:' || dst || '"', ',' ORDER BY dst) FROM e WHERE src = id AND kind = 'depends_on') AS needs, (SELECT string_agg('"urn:okf:concept:' || dst || '"', ',' ORDER BY dst) FROM e WHERE src = id AND kind = 'references') AS refs FROM c)
        SELECT id, '{{"@type":"skos:Concept","@id":"urn:okf:concept:' || id || '","skos:prefLabel":"' || title || '","skos:definition":"' || description || '"' || CASE WHEN needs IS NULL AND refs IS NULL THEN '' ELSE ',"skos:broader":[' || coalesce(needs, '') || '],"skos:related":[' || coalesce(refs, '') || ']' END || '}}' AS json FROM u""",
    "type_facets": f"SELECT type, status, count(*) AS n FROM ({_C}) c GROUP BY type, status",
    "filtered_concepts": f"SELECT id, status FROM ({_C}) c WHERE status = 'stable' AND (contains(lower(title), 'nation_1') OR contains(lower(description), 'nation_1') OR contains(lower(body), 'nation_1') OR contains(lower(tag_a), 'nation_1') OR contains(lower(tag_b), 'nation_1'))",
    "selected_concepts": f"SELECT id, type, 'some' AS way FROM ({_C}) c WHERE type = 'procedure' OR NOT EXISTS (SELECT 1 FROM ({_C}) d WHERE type = 'procedure') UNION ALL SELECT id, type, 'none left' FROM ({_C}) c",
    "queue_status": """
        WITH q AS (SELECT CASE event_id % 7 WHEN 1 THEN 'error' WHEN 2 THEN 'pending' WHEN 3 THEN 'converting' WHEN 4 THEN 'formatting' ELSE 'success' END AS s FROM events)
        SELECT count(*) AS n_total, count(*) FILTER (s = 'success') AS n_success, count(*) FILTER (s = 'error') AS n_error, count(*) FILTER (s = 'pending') AS n_pending, count(*) FILTER (s IN ('converting', 'formatting')) AS n_working, CAST(floor(100 * count(*) FILTER (s IN ('success', 'error')) / count(*) + 0.5) AS BIGINT) AS progress FROM q""",
    "crawl_totals": r"SELECT source AS domain, count(*) AS n_pages, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS n_words, max(doc_id % 5) AS deepest FROM documents GROUP BY source",
    "skill_activation": f"""
        WITH s AS ({rule_queries.SKILLS}), h AS (SELECT name, lower(description) AS d, list_sum(list_transform(['shipping', 'orders', 'from', 'nation_1', 'now'], lambda w: CASE WHEN contains(lower(description), w) OR contains(lower(name), w) THEN 1 ELSE 0 END)) / 5 AS share FROM s)
        SELECT name, share > 0.3 AS activates, CAST(least(100, floor(100 * share + 0.5)) AS BIGINT) AS confidence FROM h""",
    "carried_tails": "SELECT conv_id, turn, coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 40), '') AS context FROM conversations",
    "lexicon_csv": """
        SELECT 'canonicalName,category,aliases,baseSalience,description,enabled' AS line UNION ALL
        SELECT n_name || ',"land, ' || n_name || '",' || lower(n_name) || '; a,' || CASE n_nationkey % 3 WHEN 1 THEN '0.5' WHEN 2 THEN '1' ELSE '0.85' END || ',' ||
          CASE WHEN n_nationkey % 2 = 0 THEN '"a ""' || n_name || '""' || '"' ELSE '' END || ',' || CASE WHEN n_nationkey % 5 = 0 THEN 'false' ELSE 'true' END FROM nation""",
    "export_resources": f"SELECT id, '{{\"uri\":\"okf://concepts/' || path || '\",\"name\":\"' || title || '\",\"description\":\"' || description || '\",\"mimeType\":\"text/markdown\"}}' AS json FROM ({_C}) c",
    "extracted_entities": f"""
        WITH t AS ({_ENTITY_TEXT}), e AS (
          SELECT doc_id, lower(n_name) AS name, 'place' AS category, 0.55e0 AS salience, 1 AS occurrences, 0 AS pass FROM t JOIN nation ON n_nationkey = doc_id WHERE doc_id % 3 <> 0
          UNION ALL SELECT doc_id, 'Ada Lovelace', 'person', 0.8e0, 1, 1 FROM t UNION ALL SELECT doc_id, 'ACME Corp', 'organization', 0.75e0, 1, 2 FROM t
          UNION ALL SELECT doc_id, 'gRPC', 'protocol', 0.95e0, 2, 3 FROM t WHERE contains(text, 'grpc') UNION ALL SELECT doc_id, 'JWT', 'protocol', 0.85e0, 1, 3 FROM t
          UNION ALL SELECT doc_id, p, 'concept', 0.65e0, 1, 4 FROM t, (VALUES ('ada lovelace meets fetch_rows')) v(p) UNION ALL SELECT doc_id, 'ACME', 'protocol', 0.7e0, 1, 5 FROM t UNION ALL SELECT doc_id, 'fetch_rows', 'technology', 0.65e0, 1, 5 FROM t)
        SELECT doc_id, name, category, salience, CAST(occurrences AS BIGINT) AS occurrences, trim(regexp_replace(lower(name), '[^a-z0-9_]+', '-', 'g'), '-') AS tag, row_number() OVER (PARTITION BY doc_id ORDER BY salience DESC, pass, name) AS rank FROM e""",
}

QUERIES = {f.__name__: f for f in (filtered_concepts, selected_concepts, queue_status, crawl_totals, skill_activation, carried_tails, extracted_entities, bundle_files, vector_payload, lexicon_csv, export_resources, carried_lines, unselected_concepts, tag_unions, provenance_total, edge_titles, shown_edges, neighbours, top_concepts, bundle_issues, analysed_documents, type_facets, export_skos)}
