"""Registered queries of the graph, SPARQL, validation and export operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import graph, headers, inline, markdown, quality, retrieval, similarity, slicing, sparql
from marlstone.plans import inputs
from marlstone.sources import readers, sinks
from marlstone.session import table

AS_OF = "2026-01-01"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.concepts(spark, sf_dir).select("id", "trust_tier")


def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = inputs.sql(spark, sf_dir, f"SELECT src, './' || upper(dst) || '.md' AS target, kind FROM ({inputs.LINKS}) l")
    return graph.resolved_edges(links, _nodes(spark, sf_dir))


def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = inputs.sql(spark, sf_dir, f"SELECT src, dst AS target, kind FROM ({inputs.LINKS}) l")
    return graph.unresolved(links, _nodes(spark, sf_dir).select(F.col("id").alias("name"))).select("src", "target", "kind")


def dead_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dead_edges(_nodes(spark, sf_dir), inputs.sql(spark, sf_dir, inputs.LINKS)).groupBy("kind").agg(F.count("*").alias("n"))


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_nodes(spark, sf_dir), inputs.edges(spark, sf_dir))


def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_metrics(_nodes(spark, sf_dir), inputs.edges(spark, sf_dir), F.col("trust_tier") == "human-reviewed")


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(_nodes(spark, sf_dir), inputs.edges(spark, sf_dir)).select("id", F.round("rank", 8).alias("rank"))


def reach_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("c1", 1.0, 1), ("c2", 0.9, 2)], "id string, score double, ord long")
    return graph.expand(seeds, inputs.edges(spark, sf_dir), 2).select("id", "hop")


def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.graph_search(inputs.concepts(spark, sf_dir), inputs.edges(spark, sf_dir), "supplier of nation_1", k=3, hops=1).select("id", "hop", "score", "via")


def allowed_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds only from the guidelines; what they lead to may be anything."""
    concepts = inputs.concepts(spark, sf_dir)
    found = retrieval.graph_search(concepts, inputs.edges(spark, sf_dir), "supplier of nation_1", k=3, hops=1, allowed=concepts.where("type = 'guideline'"))
    return found.select("id", "hop", "score", "via")


def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.backlinks(inputs.edges(spark, sf_dir)).select("id", "n_sources", F.array_join("sources", ",").alias("sources"))


def top_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_nodes(_nodes(spark, sf_dir), inputs.edges(spark, sf_dir)).select("id")


def prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _nodes(spark, sf_dir).where(F.col("id").isin("c1", "c2", "c5"))
    needs = inputs.edges(spark, sf_dir).where("kind = 'depends_on'").select(F.col("src").alias("id"), F.col("dst").alias("needs"))
    return graph.with_prerequisites(seeds, needs, _nodes(spark, sf_dir)).select("id")


def semantic_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.substring("text", 1, 30).alias("title"), F.lit("idea").alias("type"), F.col("text").alias("body"))
    words = c.select("id", F.explode(F.array_distinct(F.split(F.lower("body"), r"\W+"))).alias("item")).where(F.length("item") > 8)
    return similarity.semantic_graph(c, words)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparql.triples(inputs.concepts(spark, sf_dir), inputs.edges(spark, sf_dir))


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir)


_SELECT = """
SELECT ?concept ?title ?trustTier WHERE {
  ?concept a okf:Concept ;
           dc:title ?title ;
           okf:conceptType "procedure" ;
           okf:trustTier ?trustTier .
  FILTER(regex(?trustTier, "human|machine", "i"))
} ORDER BY ?title LIMIT 12"""
_OPTIONAL = """
PREFIX okf: <urn:okf:ontology#>
SELECT ?concept ?needs WHERE { ?concept okf:status "draft" . OPTIONAL { ?concept okf:dependsOn ?needs } }"""
_CHAIN = "SELECT ?a ?b ?c WHERE { ?a okf:dependsOn ?b . ?b okf:dependsOn ?c }"
_TAGS = 'SELECT DISTINCT ?concept WHERE { ?concept okf:tag ?tag . FILTER(contains(?tag, "nation_1")) }'
_ASK = 'ASK WHERE { ?c okf:trustTier "machine-confirmed" }'
_CONSTRUCT = "CONSTRUCT { ?b okf:neededBy ?a } WHERE { ?a okf:dependsOn ?b }"


def sparql_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparql.run(_store(spark, sf_dir), _SELECT)


def sparql_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparql.run(_store(spark, sf_dir), _OPTIONAL)


def sparql_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparql.run(_store(spark, sf_dir), _CHAIN)


def sparql_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparql.run(_store(spark, sf_dir), _TAGS)


def sparql_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparql.run(_store(spark, sf_dir), _ASK)


def sparql_construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparql.run(_store(spark, sf_dir), _CONSTRUCT)


def sparql_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = inputs.sql(spark, sf_dir, "SELECT s_nationkey FROM supplier WHERE s_suppkey = 1").first()[0]
    return sparql.run(_store(spark, sf_dir), f"DESCRIBE concept:n{first}_c1")


def document_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_issues(inputs.concepts(spark, sf_dir), AS_OF)


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(quality.document_issues(inputs.concepts(spark, sf_dir), AS_OF))


def bundle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.concepts(spark, sf_dir)
    return quality.bundle_summary(c, quality.document_issues(c, AS_OF), AS_OF)


def export_jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_ld(inputs.concepts(spark, sf_dir), inputs.edges(spark, sf_dir))


def export_vault_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.vault_index(inputs.concepts(spark, sf_dir))


def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.sections(inputs.markdown(spark, sf_dir)).select("doc_id", "section", F.col("level").cast("long").alias("level"), "title", "slug", "start_line", "content")


def md_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.wikilinks(inputs.markdown(spark, sf_dir))


def md_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.markdown_links(inputs.markdown(spark, sf_dir))


#: Documents of nations under a nested header, with faults and aliases by number; Spark and DuckDB share the statement.
HEADED = f"""
SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN '' ELSE '---' || chr(10) || 'type: ' || CASE WHEN doc_id % 2 = 0 THEN 'procedure' ELSE '"guide # 1"' END || chr(10) || 'title: T ' || CAST(doc_id AS STRING) || '  # note' || chr(10) ||
  CASE doc_id % 3 WHEN 0 THEN 'depends-on:' || chr(10) || '- a' || chr(10) || '- b ' || CAST(doc_id AS STRING) || chr(10) WHEN 1 THEN 'depends_on: [x, "y, z"]' || chr(10) ELSE '' END ||
  CASE WHEN doc_id % 4 = 1 THEN 'verified:' || chr(10) || '  - by: ann' || chr(10) || '    at: 2024-01-31' || chr(10) || '    score: ' || CAST(doc_id AS STRING) || chr(10) ELSE '' END ||
  CASE WHEN doc_id % 7 = 6 THEN 'open: [1, 2' || chr(10) ELSE '' END || '---' || chr(10) END || text AS text
FROM ({inputs.MARKDOWN}) m
"""


def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents parsed whole, with a value deep in their headers."""
    docs = inputs.sql(spark, sf_dir, HEADED).withColumn("path", F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("./n/"), F.col("doc_id"), F.lit(".md"))))
    found = headers.parse_documents(docs, path_col="path")
    score = F.try_variant_get("header", "$.verified[0].score", "int").cast("long")
    return found.withColumn("score", score).withColumn("depends_on", F.array_join("depends_on", "|")).drop("header")


def md_code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.code_blocks(inputs.markdown(spark, sf_dir))


def md_fence_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.lines(inputs.markdown(spark, sf_dir))


def md_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.with_breadcrumbs(markdown.blocks(inputs.markdown(spark, sf_dir)))
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), "kind", "breadcrumb", F.col("heading_level").cast("long").alias("heading_level"), "chars")


def md_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.chunks(inputs.markdown(spark, sf_dir), most_tokens=40, flush_tokens=10).drop("languages", "links", "images")


def md_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.concepts(inputs.markdown(spark, sf_dir), as_of=AS_OF).drop("tags", "stale_after")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.chunks(table(spark, sf_dir, "documents"), most_tokens=800).select("doc_id", "chunk_index", "total_chunks", "kind", "tokens")


def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.windows(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text"), 4, 1)
    return found.select("conv_id", "window", "n_windows", "first_page", "last_page", F.length("text").cast("long").alias("chars"))


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table_markdown(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name"], ["n_regionkey"], ["n_nationkey"])


def lexicon_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    old = n.where("n_nationkey < 15").select(F.lower("n_name").alias("name"), F.lit("old").alias("category"), F.lit(0.5).alias("salience"))
    new = n.where("n_nationkey >= 10").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "new").alias("category"), F.lit(0.7).alias("salience"))
    return readers.merge_lexicons(old, new)


def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), "event_type")
    return readers.upsert_history(e.where("at % 2 = 0"), e.where("at % 2 = 1"), 50)


def selection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.selection_totals(table(spark, sf_dir, "documents"))


_C, _E, _L = inputs.CONCEPTS, inputs.EDGES, inputs.LINKS
_U = "'urn:okf:concept:' || replace(replace(path, '.md', ''), '/', '_')"
_T = f"""t AS (
  SELECT {_U} AS s, unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://purl.org/dc/elements/1.1/title', 'urn:okf:ontology#conceptType', 'urn:okf:ontology#trustTier', 'urn:okf:ontology#status', 'http://purl.org/dc/elements/1.1/description', 'urn:okf:ontology#filePath', 'urn:okf:ontology#tag', 'urn:okf:ontology#tag']) AS p,
    unnest(['urn:okf:ontology#Concept', title, type, trust_tier, status, description, path, tag_a, tag_b]) AS o, unnest([true, false, false, false, false, false, false, false, false]) AS is_uri FROM ({_C}) c
  UNION ALL SELECT 'urn:okf:concept:' || src, CASE WHEN kind = 'depends_on' THEN 'urn:okf:ontology#dependsOn' ELSE 'urn:okf:ontology#relatedTo' END, 'urn:okf:concept:' || dst, true FROM ({_E}) e)"""
_ISSUES = f"""i AS (SELECT id, unnest([
    CASE WHEN lower(type) NOT IN ('concept', 'procedure', 'table', 'metric', 'guideline', 'reference', 'architecture', 'model') THEN 'WARN_UNKNOWN_TYPE' END,
    CASE WHEN length(trim(description)) < 10 THEN 'INFO_SHORT_DESCRIPTION' END,
    CASE WHEN type = 'procedure' AND NOT regexp_matches(body, '(?m)^\\s*1\\.\\s+') THEN 'WARN_PROCEDURE_WITHOUT_STEPS' END,
    CASE WHEN trust_tier = 'human-reviewed' AND verified = '' THEN 'WARN_UNVERIFIED_HUMAN_CLAIM' END,
    CASE WHEN try_cast(stale_after AS DATE) IS NULL THEN 'ERR_INVALID_DATE_FORMAT' END, CASE WHEN try_cast(stale_after AS DATE) < DATE '{AS_OF}' THEN 'WARN_CONCEPT_STALE' END,
    CASE WHEN status NOT IN ('draft', 'stable', 'deprecated') THEN 'WARN_UNKNOWN_STATUS' END, CASE WHEN computation <> '' AND runtime = '' THEN 'WARN_MISSING_COMPUTATION_RUNTIME' END]) AS code FROM ({_C}) c),
  j AS (SELECT id, code, CASE WHEN code LIKE 'ERR%' THEN 'error' WHEN code LIKE 'WARN%' THEN 'warning' ELSE 'info' END AS severity FROM i WHERE code IS NOT NULL)"""
_ACTS = r"(regexp_matches(body, '(?im)^\s*(?:\d+\.|\*|-)\s+(?:install|run|configure|create|open|navigate|execute|add|set|build|deploy|verify)') OR regexp_matches(body, '(?is)```[a-z0-9]*\n.*?```') OR regexp_matches(body, '\|(?:\s*[-:]+\s*\|)+'))"
_LOOSE = r"len(list_distinct(list_transform(regexp_extract_all(body, '(?i)\b(?:maybe|perhaps|probably|likely|somehow|somewhere|sometime|stuff|things?|etc\.?|and so on|kind of|sort of|as needed|appropriately|whatever|to be decided|tbd|in theory|usually|mostly|normally)\b'), lambda x: lower(x))))"
_NW = r"greatest(1, len(regexp_extract_all(body, '\S+')))"
_NS = r"greatest(1, len(list_filter(string_split_regex(body, '[.!?]+(?:\s+|$)'), lambda s: length(trim(s)) > 3)))"
_LOW = "regexp_replace(lower(w), '[^a-z]', '', 'g')"
_SY = rf"coalesce(list_sum(list_transform(regexp_extract_all(body, '\S+'), lambda w: CASE WHEN length({_LOW}) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace({_LOW}, '(?:[^laeiouy]|ed|es|e)$', ''), '^y', ''), '[aeiouy]{{1,2}}'))) END)), 0)"
_LINES = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM ({inputs.MARKDOWN}) m),
  p AS (SELECT doc_id, line_no, line, starts_with(ltrim(line), '```') AS is_fence, coalesce(sum(CAST(starts_with(ltrim(line), '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_fence FROM l)"""

ORACLES = {
    "resolved_edges": _E,
    "broken_links": f"SELECT src, dst AS target, kind FROM ({_L}) l WHERE dst NOT IN (SELECT id FROM ({_C}) c)",
    "dead_edges": f"SELECT kind, count(*) AS n FROM ({_L}) l WHERE dst NOT IN (SELECT id FROM ({_C}) c) OR src NOT IN (SELECT id FROM ({_C}) c) GROUP BY kind",
    "degrees": f"SELECT id, (SELECT count(*) FROM ({_E}) e WHERE src = id) AS out_degree, (SELECT count(*) FROM ({_E}) e WHERE dst = id) AS in_degree FROM ({_C}) c",
    "graph_metrics": f"""
        WITH n AS (SELECT id, trust_tier FROM ({_C}) c), e AS ({_E})
        SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, floor((SELECT count(*) FROM e) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1)) * 1000 + 0.5) / 1000 AS density, floor(2 * (SELECT count(*) FROM e) / (SELECT count(*) FROM n) * 10 + 0.5) / 10 AS average_degree,
          (SELECT count(*) FROM n WHERE id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e)) AS isolated, CAST(floor(100 * (SELECT count(*) FROM n WHERE trust_tier = 'human-reviewed') / (SELECT count(*) FROM n) + 0.5) AS BIGINT) AS reviewed_share""",
    "pagerank": f"""
        WITH RECURSIVE n AS (SELECT id FROM ({_C}) c), k AS (SELECT count(*) AS k FROM n), e AS ({_E}), f AS (SELECT src, count(*) AS fan FROM e GROUP BY src),
        r(it, id, rank) AS (
          SELECT 0, id, 1.0e0 / k FROM n, k
          UNION ALL
          (WITH c AS (SELECT it, id, rank FROM r), g AS (SELECT e.dst AS id, sum(c.rank / f.fan) AS got FROM c JOIN e ON e.src = c.id JOIN f ON f.src = c.id GROUP BY e.dst), d AS (SELECT coalesce(sum(rank), 0) AS loose FROM c WHERE id NOT IN (SELECT src FROM f))
           SELECT c.it + 1, c.id, 0.15e0 / k + 0.85e0 * (coalesce(g.got, 0) + d.loose / k) FROM c CROSS JOIN d CROSS JOIN k LEFT JOIN g ON g.id = c.id WHERE c.it < 15))
        SELECT id, round(rank, 8) AS rank FROM r WHERE it = 15""",
    "reach_two_hops": f"""
        WITH e AS (SELECT src AS a, dst AS b FROM ({_E}) x UNION SELECT dst, src FROM ({_E}) y), h1 AS (SELECT DISTINCT b AS id FROM e WHERE a IN ('c1', 'c2') AND b NOT IN ('c1', 'c2')),
        h2 AS (SELECT DISTINCT b AS id FROM e WHERE a IN (SELECT id FROM h1) AND b NOT IN (SELECT id FROM h1) AND b NOT IN ('c1', 'c2'))
        SELECT 'c1' AS id, 0 AS hop UNION ALL SELECT 'c2', 0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""",
    "graph_search": f"""
        WITH RECURSIVE n AS (SELECT id FROM ({_C}) c), k AS (SELECT count(*) AS k FROM n), e AS ({_E}), f AS (SELECT src, count(*) AS fan FROM e GROUP BY src),
        r(it, id, rank) AS (
          SELECT 0, id, 1.0e0 / k FROM n, k
          UNION ALL
          (WITH c AS (SELECT it, id, rank FROM r), g AS (SELECT e.dst AS id, sum(c.rank / f.fan) AS got FROM c JOIN e ON e.src = c.id JOIN f ON f.src = c.id GROUP BY e.dst), d AS (SELECT coalesce(sum(rank), 0) AS loose FROM c WHERE id NOT IN (SELECT src FROM f))
           SELECT c.it + 1, c.id, 0.15e0 / k + 0.85e0 * (coalesce(g.got, 0) + d.loose / k) FROM c CROSS JOIN d CROSS JOIN k LEFT JOIN g ON g.id = c.id WHERE c.it < 15)),
        x AS (SELECT id, trust_tier, list_sum(list_transform(['supplier', 'nation'], lambda w: CASE WHEN contains(lower(title), w) THEN 5.0e0 WHEN contains(lower(tag_a || ' ' || tag_b), w) THEN 3.0e0 WHEN contains(lower(description), w) THEN 2.0e0 WHEN contains(lower(body), w) THEN 0.5e0 ELSE 0.0e0 END)) / 10.0e0 AS lexical FROM ({_C}) c),
        s AS (SELECT id, floor(score * 100 + 0.5) / 100 AS score, row_number() OVER (ORDER BY score DESC, id) AS ord FROM (SELECT x.id, (lexical * 0.5e0 + rank * 5.0e0 * 0.5e0) * CASE WHEN trust_tier = 'human-reviewed' THEN 1.25e0 ELSE 1.0e0 END AS score FROM x JOIN r ON r.id = x.id AND r.it = 15 WHERE lexical > 0.05) q ORDER BY q.score DESC, id LIMIT 3),
        w AS (SELECT e.dst AS id, s.ord, 0 AS way, kind, floor(s.score * 0.75e0 * 100 + 0.5) / 100 AS score FROM s JOIN e ON e.src = s.id UNION ALL SELECT e.src, s.ord, 1, kind, floor(s.score * 0.85e0 * 100 + 0.5) / 100 FROM s JOIN e ON e.dst = s.id),
        h AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord, way, kind) AS place FROM w WHERE id NOT IN (SELECT id FROM s))
        SELECT id, 0 AS hop, score, NULL AS via FROM s UNION ALL SELECT id, 1, score, kind FROM h WHERE place = 1""",
    "backlinks": f"SELECT dst AS id, count(DISTINCT src) AS n_sources, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM ({_E}) e GROUP BY dst",
    "top_nodes": f"SELECT id FROM ({_C}) c WHERE id NOT IN (SELECT dst FROM ({_E}) e)",
    "prerequisites": f"SELECT id FROM ({_C}) c WHERE id IN ('c1', 'c2', 'c5') OR id IN (SELECT dst FROM ({_E}) e WHERE kind = 'depends_on' AND src IN ('c1', 'c2', 'c5'))",
    "triples": f"WITH {_T} SELECT * FROM t",
    "sparql_select": f"WITH {_T} SELECT a.s AS concept, b.o AS title, d.o AS \"trustTier\" FROM t a JOIN t b ON b.s = a.s AND b.p LIKE '%/title' JOIN t c ON c.s = a.s AND c.p = 'urn:okf:ontology#conceptType' AND c.o = 'procedure' JOIN t d ON d.s = a.s AND d.p = 'urn:okf:ontology#trustTier' WHERE a.p LIKE '%#type' AND a.o = 'urn:okf:ontology#Concept' AND regexp_matches(d.o, '(?i)human|machine') ORDER BY title, concept LIMIT 12",
    "sparql_optional": f"WITH {_T} SELECT a.s AS concept, b.o AS needs FROM t a LEFT JOIN t b ON b.s = a.s AND b.p = 'urn:okf:ontology#dependsOn' WHERE a.p = 'urn:okf:ontology#status' AND a.o = 'draft'",
    "sparql_chain": f"WITH {_T} SELECT x.s AS a, x.o AS b, y.o AS c FROM t x JOIN t y ON y.s = x.o AND y.p = x.p WHERE x.p = 'urn:okf:ontology#dependsOn'",
    "sparql_distinct": f"WITH {_T} SELECT DISTINCT s AS concept FROM t WHERE p = 'urn:okf:ontology#tag' AND contains(lower(o), 'nation_1')",
    "sparql_ask": f"WITH {_T} SELECT count(*) > 0 AS answer FROM t WHERE p = 'urn:okf:ontology#trustTier' AND o = 'machine-confirmed'",
    "sparql_construct": f"WITH {_T} SELECT DISTINCT o AS s, 'urn:okf:ontology#neededBy' AS p, s AS o FROM t WHERE p = 'urn:okf:ontology#dependsOn'",
    "sparql_describe": f"WITH {_T}, u AS (SELECT {_U} AS u FROM ({_C}) c WHERE id = 'c1') SELECT s, p, o FROM t WHERE s = (SELECT u FROM u) OR o = (SELECT u FROM u)",
    "document_issues": f"WITH {_ISSUES} SELECT * FROM j",
    "validation_report": f"WITH {_ISSUES} SELECT count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info, CAST(greatest(0, 100 - 15 * count(*) FILTER (severity = 'error') - 5 * count(*) FILTER (severity = 'warning') - count(*) FILTER (severity = 'info')) AS BIGINT) AS score, count(*) FILTER (severity = 'error') = 0 AS is_valid FROM j",
    "bundle_summary": f"""
        WITH {_ISSUES}, w AS (SELECT id, max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS worst FROM j GROUP BY id), x AS (SELECT c.*, coalesce(worst, 0) AS worst FROM ({_C}) c LEFT JOIN w USING (id))
        SELECT count(*) AS n_concepts, count(*) FILTER (worst = 2) AS with_errors, count(*) FILTER (worst = 1) AS with_warnings, count(*) FILTER (worst = 0) AS valid, count(*) FILTER (trust_tier = 'unverified') AS unverified, count(*) FILTER (trust_tier = 'machine-confirmed') AS machine_confirmed, count(*) FILTER (trust_tier = 'human-reviewed') AS human_reviewed,
          count(*) FILTER (status = 'stable') AS stable, count(*) FILTER (status = 'draft') AS draft, count(*) FILTER (status = 'deprecated') AS deprecated, count(*) FILTER (try_cast(stale_after AS DATE) < DATE '{AS_OF}') AS n_stale, count(*) FILTER (try_cast(stale_after AS DATE) >= DATE '{AS_OF}' OR try_cast(stale_after AS DATE) IS NULL) AS n_fresh,
          CAST(floor(avg(greatest(10, least(100, 70 + CASE WHEN length(body) > 200 THEN 10 ELSE 0 END + CASE WHEN {_ACTS} THEN 10 ELSE 0 END + CASE WHEN {_LOOSE} = 0 THEN 10 ELSE -least(25, {_LOOSE} * 5) END))) + 0.5) AS BIGINT) AS completeness,
          CAST(floor(avg(greatest(0, least(100, floor(206.835e0 - 1.015e0 * ({_NW} / {_NS}) - 84.6e0 * ({_SY} / {_NW}) + 0.5)))) + 0.5) AS BIGINT) AS readability FROM x""",
    "md_fence_parity": f"WITH {_LINES} SELECT * FROM p",
    "md_sections": f"""
        WITH {_LINES}, h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+.+$') AND NOT is_fence AND NOT in_fence AS heads FROM p), s AS (SELECT *, CAST(sum(CAST(heads AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS section FROM h),
        g AS (SELECT doc_id, section, max(length(regexp_extract(line, '^(#+)', 1))) FILTER (heads) AS level, max(trim(regexp_extract(line, '^#+\\s+(.+)$', 1))) FILTER (heads) AS title, max(line_no) FILTER (heads) AS start_line, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT heads), '') AS content FROM s GROUP BY doc_id, section)
        SELECT doc_id, section, coalesce(level, 1) AS level, coalesce(title, 'Introduction') AS title, regexp_replace(lower(coalesce(title, 'Introduction')), '[^a-z0-9]+', '-', 'g') AS slug, coalesce(start_line, 1) AS start_line, content FROM g""",
    # What HEADED puts into the headers, and the links of MARKDOWN: a heading or two more, one link each way, one fence.
    "parsed_documents": f"""
        WITH t AS ({HEADED}), d AS (SELECT doc_id, text, doc_id % 5 <> 4 AS headed, doc_id % 5 <> 4 AND doc_id % 7 <> 6 AS good, CASE WHEN doc_id % 5 = 4 THEN text ELSE regexp_replace(text, '(?s)^---.*?\n---', '') END AS body FROM t)
        SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'n/' || doc_id WHEN good THEN 't-' || doc_id ELSE 'unnamed' END AS id,
          CASE WHEN NOT good THEN 'concept' WHEN doc_id % 2 = 0 THEN 'procedure' ELSE 'guide # 1' END AS type, CASE WHEN good THEN 'T ' || doc_id END AS title, NULL AS status,
          CASE WHEN good AND doc_id % 4 = 1 THEN 'human-reviewed' ELSE 'machine-confirmed' END AS trust_tier,
          CASE WHEN NOT good OR doc_id % 3 = 2 THEN '' WHEN doc_id % 3 = 0 THEN 'a|b ' || doc_id ELSE 'x|y, z' END AS depends_on,
          CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(len(regexp_extract_all(body, '\\S+')) AS BIGINT) AS n_words,
          CAST(4 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_sections, CAST(2 AS BIGINT) AS n_wikilinks, CAST(2 AS BIGINT) AS n_links, CAST(0 AS BIGINT) AS n_directives, CAST(1 AS BIGINT) AS n_code_blocks,
          CASE WHEN good AND doc_id % 4 = 1 THEN doc_id END AS score FROM d""",
    "md_wikilinks": f"""
        WITH {_LINES}, m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(regexp_replace(line, '`[^`]+`', ' ', 'g'), '\\[\\[[^\\]|]+(?:\\|[^\\]]+)?\\]\\]')) AS m FROM p WHERE NOT is_fence AND NOT in_fence)
        SELECT doc_id, line_no, trim(regexp_extract(m, '\\[\\[([^\\]|]+)', 1)) AS target, nullif(trim(regexp_extract(m, '\\|([^\\]]+)\\]\\]', 1)), '') AS alias FROM m""",
    "md_links": f"""
        WITH {_LINES}, m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(regexp_replace(line, '`[^`]+`', ' ', 'g'), '\\[[^\\]]+\\]\\([^)]+\\)')) AS m FROM p WHERE NOT is_fence AND NOT in_fence)
        SELECT doc_id, line_no, regexp_extract(m, '^\\[([^\\]]+)\\]', 1) AS label, regexp_extract(m, '\\]\\(([^)]+)\\)$', 1) AS url, NOT regexp_matches(m, '\\]\\((?:https?://|#|mailto:)') AS is_relative FROM m""",
    "md_code_blocks": f"""
        WITH {_LINES}, o AS (SELECT doc_id, min(line_no) AS a, max(line_no) AS b FROM p WHERE is_fence GROUP BY doc_id)
        SELECT o.doc_id, CAST(1 AS BIGINT) AS block, (SELECT regexp_extract(q.line, '^```([a-z]*)', 1) FROM p q WHERE q.doc_id = o.doc_id AND q.line_no = o.a) AS language, a AS start_line, b AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS code FROM o JOIN p ON p.doc_id = o.doc_id AND line_no > a AND line_no < b GROUP BY ALL""",
    "page_windows": """
        WITH p AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
        w AS (SELECT *, CASE WHEN n <= 4 THEN 1 ELSE CAST(ceil((n - 4) / 3) AS BIGINT) + 1 END AS n_windows FROM p), x AS (SELECT w.*, g AS "window" FROM w, unnest(range(0, n_windows)) u(g) WHERE place >= g * 3 AND place < g * 3 + 4)
        SELECT conv_id, "window", n_windows, min(turn) AS first_page, max(turn) AS last_page, CAST(sum(length('--- PAGE ' || turn || ' ---' || chr(10) || text)) + 2 * (count(*) - 1) AS BIGINT) AS chars FROM x GROUP BY conv_id, "window", n_windows""",
    "table_markdown": "SELECT n_regionkey, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey",
    "lexicon_merge": """
        WITH o AS (SELECT lower(n_name) AS name FROM nation WHERE n_nationkey < 15), n AS (SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'new' END AS category FROM nation WHERE n_nationkey >= 10)
        SELECT coalesce(n.name, o.name) AS name, coalesce(n.category, CASE WHEN o.name IS NOT NULL THEN 'old' END) AS category, CASE WHEN n.name IS NOT NULL THEN 0.7e0 ELSE 0.5e0 END AS salience, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'kept' ELSE 'updated' END AS state FROM o FULL JOIN n ON o.name = lower(n.name)""",
    "history_upsert": "SELECT user_id AS id, max(event_id) AS \"at\", arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id ORDER BY max(event_id) DESC, user_id LIMIT 50",
    "selection_totals": r"SELECT count(*) AS n_docs, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(floor(len(regexp_extract_all(text, '\S+')) * 1.33e0 + 0.5)) AS BIGINT) AS tokens FROM documents",
    "export_jsonld": f"""
        WITH c AS ({_C}), e AS ({_E}), u AS (SELECT c.*, (SELECT string_agg('"urn:okf:concept:' || dst || '"', ',' ORDER BY dst) FROM e WHERE src = id AND kind = 'depends_on') AS needs, (SELECT string_agg('"urn:okf:concept:' || dst || '"', ',' ORDER BY dst) FROM e WHERE src = id AND kind = 'references') AS refs FROM c)
        SELECT id, '{{"@type":"' || CASE type WHEN 'procedure' THEN 'HowTo' WHEN 'table' THEN 'Table' WHEN 'metric' THEN 'QuantitativeValue' WHEN 'guideline' THEN 'Policy' ELSE 'TechArticle' END || '","@id":"urn:okf:concept:' || id || '","headline":"' || title || '","name":"' || title || '","description":"' || description || '","articleBody":"' || replace(body, chr(10), '\\n') ||
          '","keywords":"' || tag_a || ', ' || tag_b || '"' || coalesce(',"dependencies":[' || needs || ']', '') || coalesce(',"citation":[' || refs || ']', '') || '}}' AS json FROM u""",
    "export_vault_index": f"SELECT type, '## ' || type || chr(10) || string_agg('- [[' || replace(path, '.md', '') || '|' || title || ']]', chr(10) ORDER BY '- [[' || replace(path, '.md', '') || '|' || title || ']]') AS index FROM ({_C}) c GROUP BY type",
}

ORACLES["allowed_graph_search"] = ORACLES["graph_search"].replace("WHERE lexical > 0.05", f"WHERE lexical > 0.05 AND x.id IN (SELECT id FROM ({_C}) c WHERE type = 'guideline')")
QUERIES = {
    f.__name__: f
    for f in (
        resolved_edges, broken_links, dead_edges, degrees, graph_metrics, pagerank, reach_two_hops, graph_search, allowed_graph_search, backlinks, top_nodes, prerequisites, semantic_graph, triples, sparql_select, sparql_optional, sparql_chain,
        sparql_distinct, sparql_ask, sparql_construct, sparql_describe, document_issues, validation_report, bundle_summary, export_jsonld, export_vault_index, md_sections, parsed_documents, md_wikilinks, md_links,
        md_code_blocks, md_fence_parity, md_blocks, md_chunks, md_concepts, document_chunks, page_windows, table_markdown, lexicon_merge, history_upsert, selection_totals,
    )
}


def ast_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inline.node_counts(inline.ast_nodes(inputs.markdown(spark, sf_dir)))


def rendered_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inline.rendered(inputs.markdown(spark, sf_dir))


def sliced_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.with_wikilinks(slicing.sliced_concepts(inputs.markdown(spark, sf_dir)))


def asset_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.sql(spark, sf_dir, _IMAGES)
    return slicing.asset_references(docs).select("doc_id", "text", F.size("assets").cast("long").alias("n_assets"), "saved_bytes")


def skill_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.skill_packages(inputs.markdown(spark, sf_dir))[0]


def container_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = slicing.container_text(slicing.typed_blocks(inputs.markdown(spark, sf_dir)))
    return made.select("doc_id", slicing.container_score(F.col("text")).alias("score"))


_IMAGES = "SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey % 5 = 4 THEN n_name ELSE 'a ![x](data:image/png;base64,' || repeat('AbC9', 1 + n_nationkey) || ') b' END || CASE WHEN n_nationkey % 2 = 0 THEN ' ![y](data:image/jpeg;base64,BB+/' || n_name || '==)' ELSE '' END || CASE WHEN n_nationkey % 3 = 0 THEN ' ![z](data:image/png;base64,zz)' ELSE '' END AS text FROM nation"
ORACLES["asset_references"] = f"""
    WITH t AS ({_IMAGES}), m AS (SELECT doc_id, text, regexp_extract_all(text, 'data:image/[a-zA-Z0-9.+-]+;base64,[A-Za-z0-9+/=]+') AS ms FROM t),
      n AS (SELECT *, regexp_replace(regexp_replace(text, 'data:image/(png);base64,[A-Za-z0-9+/=]+', 'assets/' || doc_id || '-#.\\1', 'g'), 'data:image/jpeg;base64,[A-Za-z0-9+/=]+', 'assets/' || doc_id || '-#.jpg', 'g') AS t2 FROM m)
      SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t2, '-#', '-1'), '-#', '-2'), '-#', '-3') AS text, CAST(len(ms) AS BIGINT) AS n_assets, CAST(coalesce(list_sum(list_transform(ms, lambda x: length(x))), 0) AS BIGINT) AS saved_bytes FROM n"""
QUERIES |= {f.__name__: f for f in (ast_counts, rendered_html, sliced_concepts, asset_references, skill_packages, container_scores)}
