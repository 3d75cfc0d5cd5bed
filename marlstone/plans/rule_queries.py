"""Registered queries of the rules: logic, law, secrets, skills, certificates, addresses, cycles and exports.

The SQL writes its patterns and lists out, so that a wrong one in an operator shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import cycles, graph, quality, slicing, web
from marlstone.plans import inputs
from marlstone.sources import sinks
from marlstone.session import table

#: Texts for the logic classes: (id, text, procedural, target), the last two worked out by hand.
LOGIC = (
    (0, "", 50, "concept"),
    (1, "Plain prose.", 0, "concept"),
    # modal 2.5 and condition 3.0: 5.5 / 5.6
    (2, "You must wait. On failure call someone.", 98, "skill"),
    # modal 2 x 2.5: 5.0 / 5.1; the first pattern finds must not, the second must
    (3, "You must not go.", 98, "skill"),
    # definition 4.0: 0 / 4.1
    (4, "It refers to a stone.", 0, "concept"),
    # heading: other 1.0, loop 3.2: 3.2 / 4.3
    (5, "# Title" + "\n" + "Do step 1 now.", 74, "skill"),
    # definition 4.0, modal 2.5: 2.5 / 6.6
    (6, "It is a model that must hold.", 38, "concept"),
    # shell 3.5, definitions 2 x 4: 3.5 / 11.6 is 30, below 70 with shell: 50
    (7, "It refers to a shell and stands for one." + "\n" + "```bash" + "\n" + "ls" + "\n" + "```", 50, "skill"),
    # definitions 4 x 4.0, modal 10 x 2.5 and search 2 x 2.8: 30.6 / 46.7 is 66, above 60 with over 3 definitions: 46
    (8, "must " * 10 + "lookup lookup. It refers to a, stands for, conceptually, historically.", 46, "concept"),
)
#: Clauses and terms of contracts by nation.
LAW = """
SELECT n_nationkey AS doc_id, 'Pay ' || CASE n_nationkey % 4 WHEN 0 THEN 'within 30 business days of breach' WHEN 1 THEN 'no later than thirty days after delivery' WHEN 2 THEN 'within two months following notice' ELSE 'inside of 48 hours from the statutory date' END || '; reviewed ' ||
  CASE n_nationkey % 3 WHEN 0 THEN 'quarterly' WHEN 1 THEN 'at least once per year' ELSE 'never' END || '. ' ||
  CASE n_nationkey % 5 WHEN 0 THEN 'In the event of any conflict between the Order and the Terms, the pricing Annex shall prevail.' WHEN 1 THEN 'Order of precedence: Annex, Order, Terms' WHEN 2 THEN 'Governed by the laws of ' || lower(n_name) || '.' ELSE 'Follows GDPR and SOC 2 Type II.' END AS text
FROM nation
"""
SKILLS = """
SELECT CASE WHEN s_suppkey % 7 = 0 THEN s_name ELSE 'skill-' || CAST(s_suppkey AS STRING) END AS name,
  CASE s_suppkey % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'Use when ' || s_name || ' ships' WHEN 2 THEN 'Handles the orders of ' || n_name ELSE 'Triggers: shipping from ' || n_name END AS description,
  '# ' || s_name || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN '1. Configure it' || chr(10) ELSE 'Some prose. ' END || CASE WHEN s_suppkey % 3 = 0 THEN 'Then verify the output. ' ELSE '' END || CASE WHEN s_suppkey % 5 = 0 THEN 'Rollback if needed. ' ELSE '' END ||
    CASE WHEN s_suppkey % 6 = 0 THEN '[notes](./references/r' || CAST(s_suppkey AS STRING) || '.md) ' ELSE '' END || CASE WHEN s_suppkey % 11 = 0 THEN 'api_key = "abcdefghijklmnopqrstuvwx"' ELSE '' END || CASE WHEN s_suppkey % 10 = 3 THEN repeat('lorem ', 3000) WHEN s_suppkey % 10 = 4 THEN repeat('lorem ', 6000) ELSE '' END AS body
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
REFERENCES = """
SELECT CASE WHEN s_suppkey % 7 = 0 THEN s_name ELSE 'skill-' || CAST(s_suppkey AS STRING) END AS name, 'references/r' || CAST(s_suppkey AS STRING) || '.md' AS path, repeat('word ', 900) AS content FROM supplier WHERE s_suppkey % 12 = 0 OR s_suppkey % 5 = 1
"""
SCRIPTS = """
SELECT CASE WHEN s_suppkey % 7 = 0 THEN s_name ELSE 'skill-' || CAST(s_suppkey AS STRING) END AS name, CASE WHEN s_suppkey % 9 = 1 THEN 'python' ELSE 'bash' END AS language,
  CASE WHEN s_suppkey % 2 = 0 THEN '#!/usr/bin/env bash' || chr(10) || 'set -euo pipefail' ELSE 'echo hi' END AS content FROM supplier WHERE s_suppkey % 3 = 1
"""
SECRETS = """
SELECT doc_id, text || CASE doc_id % 7 WHEN 0 THEN ' api_key = "abcdefghij0123456789"' WHEN 1 THEN ' sk-' || repeat('a1B2', 8) WHEN 2 THEN ' ghp-' || repeat('Z9', 18) WHEN 3 THEN ' AKIA' || repeat('AB12', 4) WHEN 4 THEN ' -----BEGIN RSA PRIVATE KEY-----' WHEN 5 THEN ' api_key = "short" sk-abc AKIA12' ELSE '' END AS text FROM documents
"""
ADDRESSES = """
SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'http://10.0.0.' || CAST(page_id % 250 AS STRING) || '/x' WHEN 1 THEN 'http://172.20.1.1/' WHEN 2 THEN 'http://192.168.7.7/a' WHEN 3 THEN 'https://localhost/a' WHEN 4 THEN 'https://db.internal/' WHEN 5 THEN 'ftp://a.example.com/f' WHEN 6 THEN 'no address' WHEN 7 THEN 'http://169.254.169.254/meta' WHEN 8 THEN 'http://172.40.1.1/' ELSE url END AS url FROM pages
"""


#: Every document with instructions, definitions and shell fences after its text.
GUIDES = """
SELECT doc_id, coalesce(text, '') || chr(10) || CASE doc_id % 11
  WHEN 0 THEN 'You must wait. On failure call someone.' WHEN 1 THEN 'You must not go, you shall stay; it may optionally rest.'
  WHEN 2 THEN 'It refers to a stone and stands for one.' WHEN 3 THEN '# Title' || chr(10) || 'Do step 1 now, subsequently step 2. Poll every day, keep retrying.'
  WHEN 4 THEN 'It refers to a shell and stands for one.' || chr(10) || '```bash' || chr(10) || 'ls' || chr(10) || '```' WHEN 5 THEN repeat('must ', 12) || 'lookup lookup. It refers to a, stands for, conceptually, historically.'
  WHEN 6 THEN 'For each file, scan until done; given a list of names, verify that it is so and check if the checksum fits.' WHEN 7 THEN 'If it rains then stop, unless otherwise told; in the event of rain rollback to noon. It is a protocol.'
  WHEN 8 THEN repeat('ensure that ', 11) || repeat('must not ', 3) || 'It represents the end.' WHEN 9 THEN '```sh' || chr(10) || 'a' || chr(10) || '```' || chr(10) || '```zsh' || chr(10) || 'b' || chr(10) || '```' ELSE '' END AS text
FROM documents
"""
# The families with their weights, and the definitions.
_FAMILIES = (
    (2.5, (r"\b(?:must\s+not|never\s+execute|strictly\s+prohibit(?:ed)?|do\s+not\s+(?:run|execute|modify))\b", r"\b(?:must|shall|is\s+required\s+to|ensure\s+that|mandatory\s+to|always\s+execute|strictly\s+require)\b", r"\b(?:may\s+optionally|can\s+optionally|is\s+permitted\s+to|eligible\s+to|at\s+operator'?s\s+discretion)\b")),
    (2.8, (r"\b(?:search\s+(?:for|within)|locate\s+(?:the|any)|find\s+(?:the\s+first|matching|all)|scan\s+until|lookup|grep\s+for|query\s+for)\b", r"\b(?:for\s+each|for\s+every\s+(?:item|node|element|file|record)|iterate\s+(?:through|over)|across\s+each\s+instance|repeat\s+across)\b", r"\b(?:given\s+a\s+list\s+of|where\s+target\s+matches|for\s+any\s+given)\b")),
    (3.0, (r"\b(?:if\s+.+?\s+then|in\s+the\s+event\s+(?:that|of)|provided\s+that|unless\s+otherwise|else\s+if|otherwise\s+(?:abort|fallback|retry))\b", r"\b(?:on\s+failure|on\s+exception|when\s+status\s+is|if\s+verification\s+fails)\b")),
    (3.2, (r"\b(?:while\s+(?:running|status\s+is|true)|until\s+(?:the\s+status|healthy|resolved)|poll\s+every|retry\s+until|keep\s+retrying)\b", r"\b(?:first\s*,.*?next\s*,|subsequently|prior\s+to\s+(?:running|executing)|step\s+\d+|phase\s+\d+)\b")),
    (2.6, (r"\b(?:evaluate\s+(?:whether|if)|verify\s+(?:that|the)|validate\s+(?:the|output)|assert\s+(?:that|equality)|check\s+if\s+the\s+checksum)\b", r"\b(?:filter\s+(?:out|invalid)|transform\s+each|aggregate\s+the\s+results|rollback\s+to|fallback\s+strategy)\b")),
)
_DEFINED = (
    r"\b(?:is\s+defined\s+as|refers\s+to\s+a|is\s+an?\s+(?:framework|architecture|protocol|concept|paradigm|model|abstraction|component))\b",
    r"\b(?:characterized\s+by|the\s+purpose\s+of\s+.+?\s+is|historically|in\s+theory|mathematically|consists\s+of\s+(?:the\s+following\s+concepts)?)\b",
    r"\b(?:represents\s+the|conceptually|stands\s+for|has\s+the\s+property\s+of)\b",
)


def _family(patterns: tuple[str, ...]) -> str:
    """Matches of a family in SQL: up to ten, then one for each further pattern that is found."""
    counts = ", ".join("len(regexp_extract_all(text, '(?i)" + p.replace("'", "''") + "'))" for p in patterns)
    return f"list_reduce([0, {counts}], lambda t, n: CASE WHEN t >= 10 THEN t + least(1, n) ELSE t + least(n, 10 - t) END)"


def _sql(spark: SparkSession, sf_dir: str, statement: str, *names: str) -> DataFrame:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(statement)


def logic_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame([(i, t) for i, t, _, _ in LOGIC], "id long, text string")
    return texts.select("id", *(x.alias(n) for n, x in quality.logic_class(F.col("text")).items()))


def document_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _sql(spark, sf_dir, GUIDES, "documents").withColumn("score", quality.procedural_score(F.col("text")))
    return scored.select("doc_id", *(x.alias(n) for n, x in quality.logic_class(F.col("text"), F.col("score")).items()))


def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.deadlines(_sql(spark, sf_dir, LAW, "nation"))


def precedence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.precedence_rules(_sql(spark, sf_dir, LAW, "nation"))


def legal_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.legal_metadata(_sql(spark, sf_dir, LAW, "nation")).withColumn("frameworks", F.array_join("frameworks", ","))


def secret_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SECRETS, "documents").select("doc_id", F.explode(quality.secret_kinds(F.col("text"))).alias("kind"))


def unsafe_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, ADDRESSES, "pages").select("page_id", "url", F.coalesce(web.unsafe_reason(F.col("url")), F.lit("")).alias("unsafe"))


def skill_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills, references, scripts = (_sql(spark, sf_dir, s, "supplier", "nation") for s in (SKILLS, REFERENCES, SCRIPTS))
    found = slicing.practice_audit(skills, references, scripts)
    return found.withColumn("checks", F.array_join(F.transform("checks", lambda x: x["score"].cast("string")), ","))


def certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.concepts(spark, sf_dir)
    found = quality.certificate(c, inputs.sql(spark, sf_dir, inputs.LINKS), c.where("path = 'index.md'"), c.where("id = 'c1'"))
    return found.drop("manifest")


def cyclic_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cyclic_nodes(inputs.edges(spark, sf_dir))


def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(inputs.edges(spark, sf_dir))


def cycle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring("id", 2, 20).cast("long")
    nodes = inputs.concepts(spark, sf_dir).select("id", number.alias("ord"))
    links = inputs.edges(spark, sf_dir).select("src", "dst", F.substring("dst", 2, 20).cast("long").alias("ord")).distinct()
    return cycles.cycle_report(links, nodes).select("component", "number", F.array_join("cycle", " -> ").alias("cycle"))


def skill_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = _sql(spark, sf_dir, SKILLS, "supplier", "nation").withColumns({"tools": F.when(F.length("description") > 20, F.array(F.lit("bash"))).otherwise(F.expr("cast(array() as array<string>)")), "body": F.replace("body", F.lit("./references"), F.lit("references"))})
    return quality.skill_issues(skills, _sql(spark, sf_dir, REFERENCES, "supplier"))


def export_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.turtle(inputs.concepts(spark, sf_dir), inputs.edges(spark, sf_dir))


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = inputs.edges(spark, sf_dir).withColumn("dst", F.concat(F.lit('say "'), "dst", F.lit('", now')))
    return sinks.edges_csv(named)


def export_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.export(inputs.concepts(spark, sf_dir), inputs.edges(spark, sf_dir), "neo4j")


def text_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("see ["), F.col("page_id"), F.lit("]("), "url", F.lit(") and "), "url", F.lit(", or https://example.com/a.pdf and https://example.com/b;")).alias("text"))
    return p.select("page_id", F.explode(web.web_links(F.col("text"))).alias("link"))


#: Documents with signs of formulas, venues and tables put behind them by number; Spark and DuckDB share the statement.
SIGNED = r"""
SELECT doc_id, coalesce(text, '') ||
  CASE doc_id % 7 WHEN 0 THEN ' a ≤ b ≥ c ± d ∑ e √ f' WHEN 1 THEN ' x ∞ y ∆ z' ELSE '' END ||
  CASE WHEN doc_id % 11 = 3 THEN ' In: IEEE Transactions' ELSE '' END ||
  CASE WHEN doc_id % 5 = 2 THEN chr(10) || '12   34   56' || chr(10) || '| a | b |' || chr(10) || '+---' || chr(10) || '-----' ELSE '' END ||
  CASE WHEN doc_id % 13 = 4 THEN repeat(chr(7), 600) ELSE '' END AS text
FROM documents
"""


def text_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = (F.col("doc_id") % 4).cast("long")
    found = _sql(spark, sf_dir, SIGNED, "documents")
    return found.select("doc_id", *(x.alias(n) for n, x in quality.text_complexity(F.col("text"), pages).items())).withColumn("reasons", F.array_join("reasons", "; "))


def file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.concepts(spark, sf_dir)
    return quality.file_checksums(c, c.where("id = 'c2'"), c.where("id = 'c1'"))


_C, _E, _L = inputs.CONCEPTS, inputs.EDGES, inputs.LINKS
_WORDS = "len(regexp_extract_all({0}, '\\S+'))"
_TOKENS = r"""CAST(CASE WHEN length({0}) > 0 THEN greatest(1, floor(ceil(length({0}) / 3.8e0) * 0.4e0 + ceil(len(regexp_extract_all({0}, '\S+')) * 1.28e0 + len(regexp_extract_all({0}, '[!@#$%^&*()_+={{}}\[\]:;"''<>,.?/\\|`~-]')) * 0.45e0) * 0.6e0 + 0.5e0)) ELSE 0 END AS BIGINT)"""
_DUE = r"(?i)\b(?:within|no\s+later\s+than|prior\s+to\s+the\s+expiration\s+of|inside\s+of)\s+(\d+|one|two|three|four|five|six|seven|ten|fourteen|thirty|sixty|ninety|one\s+hundred(?:\s+and\s+twenty)?)\s+(calendar\s+days?|business\s+days?|working\s+days?|hours?|weeks?|months?|years?)\s+(?:of|following|after|from)\s+([^.;,\n]+)"
_SET = r"(?i)\b(?:annually|semi-annually|quarterly|monthly|bi-weekly|on\s+a\s+(?:weekly|monthly|quarterly|annual)\s+basis|at\s+least\s+once\s+per\s+(?:year|quarter|month))\b"
_BETWEEN = r"(?i)\b(?:in\s+the\s+event\s+of\s+(?:any\s+)?(?:conflict|inconsistency|discrepancy)\s+between\s+(.+?)\s+and\s+(.+?),\s*(.+?)\s+shall\s+(?:govern|prevail|supersede|control))\b"
_OVER = r"(?i)\b(?:(.+?)\s+shall\s+(?:supersede|prevail\s+over|take\s+precedence\s+over|control\s+over)\s+(.+?)(?:\s+with\s+respect\s+to\s+(.+?))?)\b"
_RANK = r"(?i)\b(?:order\s+of\s+precedence\s*:\s*([^.\n]+))\b"
_S, _R, _P = SKILLS, REFERENCES, SCRIPTS

ORACLES = {
    "logic_class": "SELECT CAST(id AS BIGINT) AS id, CAST(p AS BIGINT) AS procedural, CAST(100 - p AS BIGINT) AS declarative, t AS target FROM (VALUES " + ", ".join(f"({i}, {p}, '{t}')" for i, _, p, t in LOGIC) + ") v(id, p, t)",
    "document_logic": rf"""
        WITH t AS ({GUIDES}), c AS (SELECT doc_id, text, {_family(_DEFINED)} AS d, len(regexp_extract_all(text, '(?is)```(?:bash|sh|shell|zsh).*?```')) AS shell, {" + ".join(f"{w}e0 * {_family(p)}" for w, p in _FAMILIES)} AS found FROM t),
        w AS (SELECT *, found + 3.5e0 * shell AS weight, 4.0e0 * d + CASE WHEN contains(text, '# ') THEN 1 ELSE 0 END AS other FROM c), s AS (SELECT *, floor(100 * weight / (weight + other + 0.1e0) + 0.5) AS s FROM w),
        u AS (SELECT *, CASE WHEN shell > 0 AND s < 70 THEN least(95, s + 20) ELSE s END AS v FROM s), x AS (SELECT doc_id, text, CASE WHEN trim(text) = '' THEN 50 WHEN d > 3 AND v > 60 THEN greatest(30, v - 20) ELSE v END AS p FROM u)
        SELECT doc_id, CAST(p AS BIGINT) AS procedural, CAST(100 - p AS BIGINT) AS declarative, CASE WHEN trim(text) <> '' AND p >= 50 THEN 'skill' ELSE 'concept' END AS target FROM x""",
    "deadlines": rf"""
        WITH t AS ({LAW}), m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_DUE}')) AS raw FROM t), s AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_SET}')) AS raw FROM t),
        g AS (SELECT doc_id, raw, lower(regexp_extract(raw, '{_DUE}', 1)) AS n, lower(regexp_extract(raw, '{_DUE}', 2)) AS u, trim(regexp_extract(raw, '{_DUE}', 3)) AS w FROM m)
        SELECT doc_id, 'relative_deadline' AS kind, trim(raw) AS raw, CAST(coalesce(try_cast(n AS BIGINT), CASE n WHEN 'two' THEN 2 WHEN 'thirty' THEN 30 ELSE 1 END) AS BIGINT) AS amount,
          CASE WHEN contains(u, 'hour') THEN 'hours' WHEN contains(u, 'business') THEN 'business_days' WHEN contains(u, 'month') THEN 'months' ELSE 'days' END AS unit, w AS trigger,
          CASE WHEN regexp_matches(raw, '(?i)\b(?:breach|default|termination|indemnity|gdpr)\b') THEN 'mandatory_breach' WHEN regexp_matches(raw, '(?i)\b(?:statute|statutory|law|regulation|jurisdiction)\b') THEN 'statutory_limit' ELSE 'operational_sla' END AS force FROM g
        UNION ALL SELECT doc_id, 'periodic_schedule', trim(raw), NULL, NULL, NULL, 'operational_sla' FROM s""",
    "precedence_rules": rf"""
        WITH t AS ({LAW}), a AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_BETWEEN}')) AS clause FROM t), o AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_RANK}')) AS clause FROM t)
        SELECT doc_id, trim(clause) AS clause, 'the pricing Annex' AS higher, regexp_extract(clause, ' and (.+?),', 1) AS lower, 'pricing_only' AS scope FROM a
        UNION ALL SELECT doc_id, trim(clause), 'Schedule / Order Form', 'Master Services Agreement', 'all_clauses' FROM o""",
    "legal_metadata": rf"""
        WITH t AS ({LAW})
        SELECT doc_id, CAST(len(regexp_extract_all(text, '{_DUE}')) + len(regexp_extract_all(text, '{_SET}')) AS BIGINT) AS n_deadlines, CAST(len(regexp_extract_all(text, '{_BETWEEN}')) + len(regexp_extract_all(text, '{_OVER}')) + len(regexp_extract_all(text, '{_RANK}')) AS BIGINT) AS n_precedence,
          CASE WHEN contains(text, 'GDPR') THEN 'GDPR,SOC 2 Type I' || CASE WHEN contains(text, 'Type II') THEN 'I' ELSE '' END ELSE '' END AS frameworks, nullif(trim(regexp_extract(text, '(?i)governed by ([a-z ,]+?)\.', 1)), '') AS governing_law FROM t""",
    "secret_kinds": rf"""
        WITH t AS ({SECRETS})
        SELECT doc_id, kind FROM (SELECT doc_id, unnest([CASE WHEN regexp_matches(text, '(?i)(?:api[_-]?key|secret[_-]?key|access[_-]?token)\s*[:=]\s*[''"][a-zA-Z0-9_\-]{{20,}}[''"]') THEN 'generic_key' END, CASE WHEN regexp_matches(text, 'sk-[a-zA-Z0-9]{{32,}}') THEN 'sk_key' END,
          CASE WHEN regexp_matches(text, 'gh[pousr]-[a-zA-Z0-9]{{36}}') THEN 'gh_token' END, CASE WHEN regexp_matches(text, 'AKIA[0-9A-Z]{{16}}') THEN 'access_id' END, CASE WHEN regexp_matches(text, '-----BEGIN (?:RSA )?PRIVATE KEY-----') THEN 'private_key' END]) AS kind FROM t) WHERE kind IS NOT NULL""",
    "unsafe_addresses": rf"""
        WITH t AS ({ADDRESSES})
        SELECT page_id, url, CASE WHEN NOT regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 'malformed' WHEN NOT regexp_matches(url, '^(?i)https?://[^/?#\s]+') THEN 'protocol' WHEN regexp_matches(url, '^https?://(localhost|127\.0\.0\.1|0\.0\.0\.0|[^/]*\.local|[^/]*\.internal)(/|$)') THEN 'local'
          WHEN regexp_matches(url, '^https?://169\.254\.169\.254') THEN 'metadata' WHEN regexp_matches(url, '^https?://(10\.|127\.|0\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)') THEN 'private' ELSE '' END AS unsafe FROM t""",
    "skill_audit": rf"""
        WITH s AS ({_S}), r AS ({_R}), p AS ({_P}),
        f AS (SELECT name, count(*) AS n, sum({_TOKENS.format('content')}) AS t FROM r GROUP BY name), q AS (SELECT name, sum({_TOKENS.format('content')}) AS t, count(*) FILTER (language = 'bash' AND NOT (contains(content, '#!/usr/bin/env bash') AND contains(content, 'set -e'))) AS loose FROM p GROUP BY name),
        e AS (SELECT s.name, description AS d, body AS b, coalesce(f.n, 0) AS n, coalesce(q.loose, 0) AS loose, {_TOKENS.format('body')} AS t, {_TOKENS.format('body')} + coalesce(f.t, 0) + coalesce(q.t, 0) AS total,
          regexp_extract(body, '\(\./(references/[a-z0-9]+\.md)\)', 1) AS link FROM s LEFT JOIN f ON f.name = s.name LEFT JOIN q ON q.name = s.name),
        c AS (SELECT name, [CASE WHEN regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 100 ELSE 0 END, CASE WHEN length(d) < 10 THEN 30 WHEN regexp_matches(d, '(?i)use when|triggers:') THEN 100 ELSE 65 END, CASE WHEN t <= 3500 THEN 100 WHEN t <= 5000 THEN 75 ELSE 20 END,
          CASE WHEN n > 0 THEN 100 WHEN total < 1500 THEN 90 ELSE 60 END, CASE WHEN contains(b, '1. Configure') THEN 100 ELSE 50 END, CASE WHEN contains(b, 'verify') THEN 100 ELSE 40 END, CASE WHEN contains(b, 'Rollback') THEN 100 ELSE 50 END, CASE WHEN loose = 0 THEN 100 ELSE 70 END,
          CASE WHEN contains(b, 'api_key = "abc') THEN 0 ELSE 100 END, CASE WHEN link = '' OR EXISTS (SELECT 1 FROM r WHERE r.name = e.name AND r.path = e.link) THEN 100 ELSE 0 END] AS c FROM e), x AS (SELECT name, c, CAST(floor(list_sum(c) / 10 + 0.5) AS BIGINT) AS score FROM c)
        SELECT name, score, CASE WHEN score >= 95 THEN 'A+' WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' ELSE 'F' END AS grade, score >= 80 AND c[1] > 0 AND c[3] > 20 AND c[9] > 0 AND c[10] > 0 AS is_compliant, array_to_string(c, ',') AS checks FROM x""",
    "certificate": f"""
        WITH c AS ({_C}), b AS (SELECT (SELECT count(*) FROM c WHERE title = '') AS untitled, (SELECT count(*) FROM c WHERE path = 'index.md') AS idx, (SELECT count(*) FROM c WHERE id = 'c1') AS log,
          (SELECT count(*) FROM ({_L}) l WHERE dst NOT IN (SELECT id FROM c) OR src NOT IN (SELECT id FROM c)) AS dead, (SELECT floor(avg(CASE WHEN regexp_matches(body, '(?im)^\\s*1\\.\\s+install') THEN 90 ELSE 80 END) + 0.5) FROM c) AS completeness, (SELECT count(*) FROM c WHERE verified = '' OR status NOT IN ('stable', 'draft', 'deprecated')) AS unsourced, (SELECT count(*) FROM c WHERE trust_tier = 'human-reviewed') AS reviewed),
        r AS (SELECT unnest(['SPEC-001', 'SPEC-002', 'SPEC-003', 'SPEC-004', 'SPEC-005', 'SPEC-006']) AS rule, unnest([CASE WHEN untitled > 0 THEN 'failed' ELSE 'passed' END, CASE WHEN idx = 0 THEN 'warning' ELSE 'passed' END, CASE WHEN log = 0 THEN 'warning' ELSE 'passed' END, CASE WHEN dead > 0 THEN 'failed' ELSE 'passed' END, CASE WHEN completeness < 80 THEN 'warning' ELSE 'passed' END, CASE WHEN unsourced > 0 THEN 'warning' ELSE 'passed' END]) AS status, reviewed FROM b),
        n AS (SELECT count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'warning') AS w FROM r)
        SELECT rule, status, CAST(greatest(0, 100 - 30 * f - 10 * w) AS BIGINT) AS score, CASE WHEN f > 0 THEN 'NON_COMPLIANT' WHEN w > 0 OR reviewed = 0 THEN 'CERTIFIED_SILVER' ELSE 'CERTIFIED_GOLD' END AS level FROM r, n""",
    # Components by the closure; then each is searched step by step: a row holds the path, the place of each of its nodes
    # among its links, the nodes met, and the cycle that the step closed.
    "cycle_report": f"""
        WITH RECURSIVE e AS ({_E}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
        c AS (SELECT x.a AS id, max(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a),
        adj AS (SELECT a.id, a.component, list(DISTINCT e.dst ORDER BY CAST(substr(e.dst, 2) AS BIGINT)) AS dsts FROM e JOIN c a ON a.id = e.src JOIN c b ON b.id = e.dst AND b.component = a.component GROUP BY ALL),
        w(component, path, pos, met, closed, step) AS (
          SELECT component, [arg_min(id, CAST(substr(id, 2) AS BIGINT))], [1], [arg_min(id, CAST(substr(id, 2) AS BIGINT))], CAST(NULL AS VARCHAR[]), 0 FROM c GROUP BY component
          UNION ALL
          SELECT w.component,
            CASE WHEN d.dst IS NULL THEN path[:-2] WHEN list_contains(met, d.dst) THEN path ELSE list_append(path, d.dst) END,
            CASE WHEN d.dst IS NULL THEN pos[:-2] WHEN list_contains(met, d.dst) THEN list_append(pos[:-2], pos[-1] + 1) ELSE list_append(list_append(pos[:-2], pos[-1] + 1), 1) END,
            CASE WHEN d.dst IS NULL OR list_contains(met, d.dst) THEN met ELSE list_append(met, d.dst) END,
            CASE WHEN list_contains(path, d.dst) THEN list_append(path[list_position(path, d.dst):], d.dst) END, step + 1
          FROM w JOIN adj ON adj.id = w.path[-1] CROSS JOIN LATERAL (SELECT adj.dsts[w.pos[-1]] AS dst) d WHERE len(path) > 0
        )
        SELECT component, row_number() OVER (PARTITION BY component ORDER BY step) AS number, array_to_string(closed, ' -> ') AS cycle FROM w WHERE closed IS NOT NULL""",
    "cyclic_nodes": f"WITH RECURSIVE e AS ({_E}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT DISTINCT a AS id FROM r WHERE a = b",
    "strong_components": f"WITH RECURSIVE e AS ({_E}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT x.a AS id, max(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a",
    "skill_issues": rf"""
        WITH s AS (SELECT name, description, replace(body, './references', 'references') AS body FROM ({_S}) x), r AS ({_R}), t AS (SELECT *, {_TOKENS.format('body')} AS t FROM s),
        i AS (SELECT name, unnest(['SKILL-001', 'SKILL-002', 'SKILL-003', 'SKILL-003', 'SKILL-005', 'SKILL-006', 'SKILL-004']) AS rule, unnest(['error', 'warning', 'error', 'warning', 'info', 'error', 'error']) AS severity,
          unnest([NOT regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)*$'), NOT regexp_matches(description, '(?i)\b(?:use when|when|trigger|if|for)\b'), t > 5000, t > 3500 AND t <= 5000, length(description) <= 20, contains(body, 'api_key = "abcdefghijklmnopqrstuvwx"'),
            contains(body, '(references/') AND NOT EXISTS (SELECT 1 FROM r WHERE r.name = t.name AND contains(t.body, '(' || r.path || ')'))]) AS bad FROM t)
        SELECT name, rule, severity FROM i WHERE bad""",
    "export_turtle": f"""
        WITH c AS ({_C}), l AS (SELECT src, string_agg('    okf:' || CASE kind WHEN 'depends_on' THEN 'dependsOn' ELSE 'references' END || ' kb:' || dst || ' ;', chr(10) ORDER BY '    okf:' || CASE kind WHEN 'depends_on' THEN 'dependsOn' ELSE 'references' END || ' kb:' || dst || ' ;') AS links FROM ({_E}) e GROUP BY src)
        SELECT id, concat_ws(chr(10), 'kb:' || id || ' a okf:Concept ;', '    rdfs:label "' || title || '" ;', '    okf:conceptType "' || type || '" ;', '    okf:trustTier "' || trust_tier || '" ;', '    okf:status "' || status || '" ;', '    dc:description "' || description || '" ;', '    okf:tag "' || tag_a || '", "' || tag_b || '" ;', links, '    okf:inBundle kb:bundle .') AS turtle FROM c LEFT JOIN l ON l.src = c.id""",
    "export_csv": f"SELECT src || ',\"say \"\"' || dst || '\"\", now\",' || kind AS line FROM ({_E}) e",
    "export_statements": f"""
        SELECT 'MERGE (c:Concept {{id: "' || id || '"}}) SET c.title = "' || title || '", c.type = "' || type || '";' AS line FROM ({_C}) c
        UNION ALL SELECT 'MATCH (a:Concept {{id: "' || src || '"}}), (b:Concept {{id: "' || dst || '"}}) MERGE (a)-[:' || upper(kind) || ']->(b);' FROM ({_E}) e""",
    "text_links": "SELECT page_id, link FROM (SELECT page_id, unnest(list_distinct([url, 'https://example.com/b'])) AS link FROM pages) WHERE regexp_matches(link, '^https?://[^/?#]+') AND NOT regexp_matches(lower(link), '^[^?#]*\\.(?:pdf|zip|jpg|jpeg|png|gif|css|js|xml|json|svg|ico|mp4|mp3)(?:/|$)')",
    # The patterns are the reference's, written for RE2.
    "text_complexity": r"""
        WITH d AS (SELECT doc_id, text, doc_id % 4 AS pages, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM ("""
    + SIGNED
    + r""") x),
        m AS (SELECT doc_id, pages, text, CASE WHEN pages > 0 THEN floor(length(text) / pages + 0.5) ELSE 0 END AS per,
          (CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda x: length(x) > 4 AND length(x) < 38 AND NOT starts_with(x, '#') AND NOT starts_with(x, '-'))) / len(ls) ELSE 0 END) > 0.32
            OR regexp_matches(text, '(?i)cacm|acm|draft v\d|journal|conference|ieee|arxiv|col-2|two-column') AS cols,
          len(regexp_extract_all(text, '(\\\(|\\\[|\\sum|\\int|\\partial|\\alpha|\\beta|\\gamma|\\delta|\\theta|\\lambda|\\approx|\\frac|\\le|\\ge|\\neq|\\in|\\forall|\\exists|\\rightarrow|√|∫|∑|∏|∞|≤|≥|≠|≈|∂|∆|±)')) AS math,
          len(regexp_extract_all(text, '(?m)(\|[^\n]+\||^\s*[\+\-]{3,}\s*$|^\s*\d+[\t\s]{2,}\d+[\t\s]{2,}\d+)')) AS tabs, len(regexp_extract_all(text, '[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]')) / greatest(1, length(text)) AS bad FROM d),
        f AS (SELECT *, pages = 0 OR per < 60 AS scanned FROM m),
        g AS (SELECT *, least(100, 40 * CAST(scanned AS INT) + 30 * CAST(cols AS INT) + 25 * CAST(math >= 5 AS INT) + 20 * CAST(tabs >= 3 AS INT) + 25 * CAST(bad > 0.005 AS INT)) AS score FROM f)
        SELECT doc_id, CAST(per AS BIGINT) AS chars_per_page, scanned, cols AS columns, CAST(math AS BIGINT) AS math, CAST(tabs AS BIGINT) AS tables, CAST(score AS BIGINT) AS score,
          CASE WHEN scanned OR math >= 5 OR bad > 0.005 OR score >= 40 THEN 'visual' ELSE 'fast' END AS route,
          CASE WHEN score = 0 THEN 'Standard single-column text structure with clean embedded fonts' ELSE array_to_string(list_filter([
            CASE WHEN scanned THEN 'Low text density (<60 chars/page) - scanned/image document requiring visual OCR' END, CASE WHEN cols THEN 'Multi-column / side-by-side text layout structure detected' END,
            CASE WHEN math >= 5 THEN 'High math & LaTeX formula density (' || math || ' math symbols)' END, CASE WHEN tabs >= 3 THEN 'Complex tabular layout grid detected (' || tabs || ' table markers)' END,
            CASE WHEN bad > 0.005 THEN 'Corrupted embedded font encoding detected (' || printf('%.1f', bad * 100) || '% garbled glyphs)' END], lambda x: x IS NOT NULL), '; ') END AS reasons FROM g""",
    "file_checksums": f"""
        WITH c AS ({_C}), f AS (
          SELECT path, type, '---' || chr(10) || 'type: ' || type || chr(10) || 'title: "' || title || '"' || chr(10) || 'status: ' || status || chr(10) || 'tags: [' || tag_a || ', ' || tag_b || ']' || chr(10) || '---' || chr(10) || chr(10) || body AS text FROM c
          UNION ALL SELECT 'INDEX.md', 'reserved/index', body FROM c WHERE id = 'c2' UNION ALL SELECT 'logs/CONVERSION.md', 'reserved/log', body FROM c WHERE id = 'c1')
        SELECT path, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256, type FROM f""",
}

QUERIES = {f.__name__: f for f in (logic_class, document_logic, deadlines, precedence_rules, legal_metadata, secret_kinds, unsafe_addresses, skill_audit, certificate, cyclic_nodes, strong_components, cycle_report, skill_issues, export_turtle, export_csv, export_statements, text_links, text_complexity, file_checksums)}
