"""Sinks: graph and document formats written by partition; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types of the linked-data vocabulary.
SCHEMA_TYPES = {"procedure": "HowTo", "table": "Table", "metric": "QuantitativeValue", "guideline": "Policy"}
_EDGE_NAMES = {"depends_on": "dependsOn", "implements": "implements", "references": "references"}


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _schema_type(c: Column) -> Column:
    out = None
    for k, v in SCHEMA_TYPES.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise("TechArticle")


def turtle(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, turtle): the statements of each concept with its outgoing edges."""
    slug = lambda c: F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_")
    name = F.lit("relatedTo")
    for k, v in _EDGE_NAMES.items():
        name = F.when(F.col("kind") == k, v).otherwise(name)
    line = F.concat(F.lit("    okf:"), name, F.lit(" kb:"), slug(F.col("dst")), F.lit(" ;"))
    out = edges.select(F.col("src").alias("id"), line.alias("line")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("links"))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("    okf:tag "), F.array_join(F.transform("tags", _quoted), ", "), F.lit(" ;")))
    body = F.concat_ws(
        "\n", F.concat(F.lit("kb:"), slug(F.col("id")), F.lit(" a okf:Concept ;")), F.concat(F.lit("    rdfs:label "), _quoted(F.col("title")), F.lit(" ;")),
        F.concat(F.lit("    okf:conceptType "), _quoted(F.col("type")), F.lit(" ;")), F.concat(F.lit("    okf:trustTier "), _quoted(F.col("trust_tier")), F.lit(" ;")),
        F.concat(F.lit("    okf:status "), _quoted(F.col("status")), F.lit(" ;")), F.when(F.length("description") > 0, F.concat(F.lit("    dc:description "), _quoted(F.col("description")), F.lit(" ;"))), tags, F.col("links"), F.lit("    okf:inBundle kb:bundle ."),
    )
    return concepts.join(out, "id", "left").select("id", body.alias("turtle"))


def json_ld(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, json): a linked-data node of each concept."""
    uri = lambda c: F.concat(F.lit("urn:okf:concept:"), c)
    by = {"dependencies": "depends_on", "citation": "references", "isImplementationOf": "implements", "mentions": "related_to"}
    ends = edges.groupBy(F.col("src").alias("id")).agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, uri(F.col("dst"))))).alias(n) for n, k in by.items()))
    some = lambda n: F.when(F.size(n) > 0, F.col(n)).alias(n)
    node = F.struct(_schema_type(F.col("type")).alias("@type"), uri(F.col("id")).alias("@id"), F.col("title").alias("headline"), F.col("title").alias("name"), "description", F.col("body").alias("articleBody"), F.array_join("tags", ", ").alias("keywords"), *(some(n) for n in by))
    return concepts.join(ends, "id", "left").select("id", F.to_json(node).alias("json"))


def skos(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, json): thesaurus nodes; what a concept depends on is broader, what relates is related."""
    uri = lambda c: F.concat(F.lit("urn:okf:concept:"), c)
    ends = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.when(F.col("kind").isin("depends_on", "implements"), uri(F.col("dst"))))).alias("broader"), F.array_sort(F.collect_list(F.when(~F.col("kind").isin("depends_on", "implements"), uri(F.col("dst"))))).alias("related"))
    node = F.struct(F.lit("skos:Concept").alias("@type"), uri(F.col("id")).alias("@id"), F.col("title").alias("skos:prefLabel"), F.col("description").alias("skos:definition"), F.col("broader").alias("skos:broader"), F.col("related").alias("skos:related"))
    return concepts.join(ends, "id", "left").select("id", F.to_json(node).alias("json"))


def property_graph(concepts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and relationship rows as statements of a property-graph query language."""
    nodes = concepts.select("id", F.concat(F.lit("MERGE (c:Concept {id: "), _quoted(F.col("id")), F.lit("}) SET c.title = "), _quoted(F.col("title")), F.lit(", c.type = "), _quoted(F.col("type")), F.lit(";")).alias("statement"))
    links = edges.select("src", "dst", F.concat(F.lit("MATCH (a:Concept {id: "), _quoted(F.col("src")), F.lit("}), (b:Concept {id: "), _quoted(F.col("dst")), F.lit("}) MERGE (a)-[:"), F.upper("kind"), F.lit("]->(b);")).alias("statement"))
    return nodes, links


def _cell(c: Column) -> Column:
    """A value as a cell of a comma-separated file."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def edges_csv(edges: DataFrame) -> DataFrame:
    """(line): source, target and kind of each edge, with cells quoted where they must be."""
    return edges.select(F.concat_ws(",", _cell(F.col("src")), _cell(F.col("dst")), _cell(F.col("kind"))).alias("line"))


def lexicon_csv(lexicon: DataFrame) -> DataFrame:
    """(line): the header and each entry of a lexicon (name, category, aliases, salience, description, enabled).

    Lines are for a text file with "\\r\\n" between them. A missing salience is 0.85, a missing switch true.
    """
    salience = F.regexp_replace(F.coalesce(F.col("salience").cast("double"), F.lit(0.85)).cast("string"), r"\.0$", "")
    cells = [F.col("name"), F.col("category"), F.array_join("aliases", "; "), salience, F.col("description"), F.when(F.coalesce(F.col("enabled"), F.lit(True)), "true").otherwise("false")]
    header = lexicon.sparkSession.createDataFrame([("canonicalName,category,aliases,baseSalience,description,enabled",)], "line string")
    return header.unionAll(lexicon.select(F.concat_ws(",", *map(_cell, cells)).alias("line")))


def vector_payload(chunks: DataFrame, namespace: str) -> DataFrame:
    """(id, json): an upsert record of each chunk for a vector store, without its vector.

    chunks: doc_id, chunk_index, total_chunks, embedding_text, breadcrumb, tokens.
    """
    ident = F.concat_ws("-", F.lit(namespace), F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    node = F.struct(ident.alias("id"), F.col("embedding_text").alias("text"), F.struct("doc_id", "chunk_index", "total_chunks", "breadcrumb", "tokens").alias("metadata"))
    return chunks.select(ident.alias("id"), F.to_json(node).alias("json"))


def vault_index(concepts: DataFrame) -> DataFrame:
    """(type, index): a list of links to the concepts of each type."""
    line = F.concat(F.lit("- [["), F.regexp_replace("path", r"\.md$", ""), F.lit("|"), F.col("title"), F.lit("]]"))
    return concepts.groupBy("type").agg(F.concat(F.lit("## "), F.first("type"), F.lit("\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("index"))


def tool_resources(concepts: DataFrame) -> DataFrame:
    """(id, json): a resource descriptor of each concept for a tool server."""
    node = F.struct(F.concat(F.lit("okf://concepts/"), "path").alias("uri"), F.col("title").alias("name"), "description", F.lit("text/markdown").alias("mimeType"))
    return concepts.select("id", F.to_json(node).alias("json"))


def summary_index(concepts: DataFrame) -> DataFrame:
    """(id, json): the short entry of each concept in the index of a bundle."""
    return concepts.select("id", F.to_json(F.struct("id", "path", "title", "type", "description", "tags")).alias("json"))


def write_bundle(concepts: DataFrame, edges: DataFrame, folder: str) -> None:
    """Concepts by type, edges and the exports, as files of a folder."""
    concepts.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/concepts")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")
    turtle(concepts, edges).select("turtle").write.mode("overwrite").text(f"{folder}/turtle")
    json_ld(concepts, edges).select("json").write.mode("overwrite").text(f"{folder}/jsonld")
    vault_index(concepts).select("index").write.mode("overwrite").text(f"{folder}/index")


def export(concepts: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """One column ``line``: turtle or ttl, jsonld, skos, mcp, csv, neo4j; index (the vault's), summary."""
    if kind in ("turtle", "ttl"):
        return turtle(concepts, edges).select(F.col("turtle").alias("line"))
    if kind in ("jsonld", "schema-org", "compacted"):
        return json_ld(concepts, edges).select(F.col("json").alias("line"))
    if kind == "skos":
        return skos(concepts, edges).select(F.col("json").alias("line"))
    if kind == "mcp":
        return tool_resources(concepts).select(F.col("json").alias("line"))
    if kind == "csv":
        return edges_csv(edges)
    if kind == "neo4j":
        nodes, links = property_graph(concepts, edges)
        return nodes.select(F.col("statement").alias("line")).unionAll(links.select(F.col("statement").alias("line")))
    if kind == "summary":
        return summary_index(concepts).select(F.col("json").alias("line"))
    if kind in ("index", "vault"):
        return vault_index(concepts).select(F.col("index").alias("line"))
    raise ValueError(f"no export of the kind {kind}")
