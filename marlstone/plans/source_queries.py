"""Registered queries of sources and sinks that keep files: bundles and archives written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import json_schema
from marlstone.session import shared_dir, table
from marlstone.sources import archives, bundles, readers
from marlstone.streaming import queue


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/bundle-{uuid.uuid4().hex}"


def bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of a bundle; what the manifest lists, and whether the archives hold it."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", F.concat(F.col("doc_id"), F.lit(".md"))).alias("path"), "text")
    folder = _folder(spark)
    bundles.write_bundle_files(docs, folder)
    return bundles.bundle_listing(spark, folder).join(bundles.verified(spark, folder), ["path", "archive"]).select("path", "size", "sha256", "state")


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as members of archives, in files of several kinds, read back as documents."""
    turns = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "MD").when(F.col("role") == "assistant", "txt").otherwise("log")
    hidden = F.when(F.col("turn") % 5 == 4, ".cache/").otherwise("")
    folder = _folder(spark)
    bundles.write_bundle_files(turns.select(F.concat(F.col("conv_id"), F.lit("/"), hidden, F.col("turn"), F.lit("."), kind).alias("path"), "text"), folder)
    read = archives.read_documents(spark, folder, partition_bytes=1 << 20)
    return read.groupBy("extension").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum(F.conv(F.substring(F.sha2("content", 256), 1, 8), 16, 10).cast("long")).alias("checksum"), F.count("error").alias("errors"))


def queued_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the conversion queue, one attempt each; texts of one line fail."""

    def convert(text: str) -> str:
        if "\n" not in text:
            raise ValueError("one line")
        return "# " + text

    folder = _folder(spark)
    path = f"{sf_dir.rstrip('/')}/documents.parquet"
    docs = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")  # a pattern, as a stream takes no path of a single file
    events = docs.select("doc_id", F.lit("document").alias("kind"), "text", F.lit(0).alias("ord"))
    queue.run_queue(events, f"{folder}/log", f"{folder}/checkpoint", convert, max_attempts=1, interval=None).awaitTermination()
    return queue.queue_table(spark, f"{folder}/log").select("doc_id", "status", "attempts", "error", F.length("markdown").cast("long").alias("n_chars"))


def paged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of orders as glyph runs on two pages, put together as lines."""
    runs = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2 + 1).alias("page"), (F.col("l_suppkey") % 5).alias("x"), (F.col("l_partkey") % 24 / 2).alias("y"), F.concat("l_returnflag", F.col("l_linenumber")).alias("text")
    )
    return readers.paged_text(runs)


#: A record of each preset for every supplier, with faults by number; Spark and DuckDB share the statement.
RECORDS = """
SELECT s_suppkey AS k, 'api_reference' AS preset, '{"apiName": "' || s_name || '", "endpoints": [{"method": "' || CASE WHEN s_suppkey % 3 = 0 THEN 'FETCH' ELSE 'GET' END || '", "path": "/s", "summary": "x"}, {"method": "POST", "path": "/t", ' ||
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '"summary": "y", ' END || '"parameters": [{"name": "q", "in": "' || CASE WHEN s_suppkey % 5 = 0 THEN 'cookie' ELSE 'query' END || '", "required": true, "type": "string"}]}]}' AS text FROM supplier
UNION ALL SELECT s_suppkey, 'pricing_tiers', '{"productName": "' || s_name || '", "plans": ' || CASE WHEN s_suppkey % 3 = 0 THEN '"none"' ELSE '[{"name": "Free", "featuresIncluded": ["a", "b"], "isPopular": ' || CASE WHEN s_suppkey % 4 = 0 THEN '"yes"' ELSE 'true' END || '}]' END || '}' FROM supplier
UNION ALL SELECT s_suppkey, 'faq_qna', CASE WHEN s_suppkey % 2 = 0 THEN '```json' || chr(10) ELSE '' END || '{"topic": null, "items": [{"question": "q", "answer": ' || CASE WHEN s_suppkey % 3 = 0 THEN 'null' ELSE '"a"' END || '}], "page": 1}' || CASE WHEN s_suppkey % 2 = 0 THEN chr(10) || '```' ELSE '' END FROM supplier
UNION ALL SELECT s_suppkey, 'product_specs', '{"productTitle": "' || s_name || '"' || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE ', "technicalSpecs": []' END || ', "keyFeatures": [' || CASE WHEN s_suppkey % 2 = 0 THEN '1' ELSE '"1"' END || ', "x"]}' FROM supplier
UNION ALL SELECT s_suppkey, 'entities_relations', '{"entities": [{"id": "a", "name": "A", "type": "' || CASE WHEN s_suppkey % 7 = 0 THEN 'Thing' ELSE 'Person' END || '"}, 5]' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ', "relations": [{"sourceId": "a", "predicate": "is", "targetId": "a"}]' END || '}' FROM supplier
UNION ALL SELECT s_suppkey, 'course_syllabus', CASE WHEN s_suppkey % 6 = 0 THEN '{"courseTitle": ' ELSE '{"courseTitle": "C", "modules": [{"moduleNumber": ' || CASE WHEN s_suppkey % 4 = 0 THEN '"1"' ELSE '1.5' END || ', "title": "T", "topics": ["t"]}]}' END FROM supplier
"""


def json_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of each preset for every supplier: is it valid, what is wrong, and a value of its typed data."""
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    records = spark.sql(RECORDS)
    shown = {
        "api_reference": "data.endpoints[1].parameters[0].name", "pricing_tiers": "cast(size(data.plans) as string)", "faq_qna": "data.items[0].question", "product_specs": "data.keyFeatures[1]",
        "entities_relations": "data.relations[0].predicate", "course_syllabus": "cast(data.modules[0].moduleNumber as string)",
    }
    parts = [json_schema.extracted(records.where(F.col("preset") == name), "text", name).selectExpr("preset", "k", "valid", "array_join(issues, '; ') AS issues", "array_join(extra, ',') AS extra", f"{value} AS value") for name, value in shown.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


ORACLES = {
    # Heights from the top, one a step: each keeps the anchor or becomes one.
    "paged_lines": """
        WITH RECURSIVE r AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 + 1 AS page, l_suppkey % 5 AS x, l_partkey % 24 / 2 AS y, l_returnflag || l_linenumber AS text FROM lineitem),
        h AS (SELECT doc_id, page, y, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC) AS n FROM (SELECT DISTINCT doc_id, page, y FROM r)),
        a(doc_id, page, n, y, anchor) AS (
          SELECT doc_id, page, n, y, y FROM h WHERE n = 1
          UNION ALL SELECT h.doc_id, h.page, h.n, h.y, CASE WHEN a.anchor - h.y > 3 THEN h.y ELSE a.anchor END FROM a JOIN h ON h.doc_id = a.doc_id AND h.page = a.page AND h.n = a.n + 1
        ),
        l AS (SELECT r.doc_id, r.page, anchor, string_agg(text, ' ' ORDER BY x, text) AS line FROM r JOIN a ON a.doc_id = r.doc_id AND a.page = r.page AND a.y = r.y GROUP BY ALL),
        p AS (SELECT doc_id, page, '--- PAGE ' || page || ' ---' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY anchor DESC) AS text FROM l GROUP BY doc_id, page)
        SELECT doc_id, count(*) AS n_pages, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM p GROUP BY doc_id""",
    # By the schemas of the presets, read by hand: the faults of RECORDS and what is said of each.
    "json_presets": """
        WITH r AS (SELECT s_suppkey AS k FROM supplier), f AS (
          SELECT k, 'api_reference' AS preset, [CASE WHEN k % 3 = 0 THEN 'endpoints[0].method: not one of GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS' END, CASE WHEN k % 4 = 0 THEN 'endpoints[1].summary: required' END, CASE WHEN k % 5 = 0 THEN 'endpoints[1].parameters[0].in: not one of query|header|path|body' END] AS said, '' AS extra, 'q' AS value FROM r
          UNION ALL SELECT k, 'pricing_tiers', [CASE WHEN k % 3 = 0 THEN 'plans: expected array' WHEN k % 4 = 0 THEN 'plans[0].isPopular: expected boolean' END], '', CASE WHEN k % 3 = 0 THEN NULL ELSE '1' END FROM r
          UNION ALL SELECT k, 'faq_qna', [CASE WHEN k % 3 = 0 THEN 'items[0].answer: required' END], 'page', 'q' FROM r
          UNION ALL SELECT k, 'product_specs', [CASE WHEN k % 5 = 0 THEN 'technicalSpecs: required' END, CASE WHEN k % 2 = 0 THEN 'keyFeatures[0]: expected string' END], '', 'x' FROM r
          UNION ALL SELECT k, 'entities_relations', [CASE WHEN k % 7 = 0 THEN 'entities[0].type: not one of Person|Organization|Concept|Location|Technology|Event|Metric' END, 'entities[1]: expected object', CASE WHEN k % 3 = 0 THEN 'relations: required' END], '', CASE WHEN k % 3 = 0 THEN NULL ELSE 'is' END FROM r
          UNION ALL SELECT k, 'course_syllabus', [CASE WHEN k % 6 = 0 THEN 'not JSON' WHEN k % 4 = 0 THEN 'modules[0].moduleNumber: expected number' END], CASE WHEN k % 6 = 0 THEN NULL ELSE '' END, CASE WHEN k % 6 = 0 OR k % 4 = 0 THEN NULL ELSE '1.5' END FROM r
        ), g AS (SELECT *, list_filter(said, lambda x: x IS NOT NULL) AS faults FROM f)
        SELECT preset, k, len(faults) = 0 AS valid, array_to_string(faults, '; ') AS issues, extra, value FROM g""",
    "queued_documents": """
        SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN 'success' ELSE 'error' END AS status, 1 AS attempts,
          CASE WHEN contains(text, chr(10)) THEN NULL ELSE 'one line' END AS error, CASE WHEN contains(text, chr(10)) THEN length(text) + 2 END AS n_chars
        FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""",
    "bundle_round_trip": """
        SELECT lang || '/' || doc_id || '.md' AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha256, 'ok' AS state FROM documents""",
    "archive_members": """
        SELECT CASE role WHEN 'user' THEN 'md' ELSE 'txt' END AS extension, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes,
          CAST(sum(CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT)) AS BIGINT) AS checksum, 0 AS errors
        FROM conversations WHERE role IN ('user', 'assistant') AND turn % 5 <> 4 GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (bundle_round_trip, archive_members, queued_documents, json_presets, paged_lines)}
