"""Linked data of concepts as a thesaurus with their provenance: scheme, concepts and the activities that made them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The name spaces, and the terms of the context.
NAMESPACES = {
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "prov": "http://www.w3.org/ns/prov#",
    "schema": "https://schema.org/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "owl": "http://www.w3.org/2002/07/owl#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "okf": "https://okf.md/spec/v0.2/",
}
PLAIN_TERMS = "skos:ConceptScheme skos:Concept prov:Entity prov:SoftwareAgent prov:Activity okf:trustTier okf:deterministicHash okf:conceptType okf:qualityScore".split()
ENGLISH_TERMS = "skos:prefLabel skos:definition skos:scopeNote".split()
LINK_TERMS = "skos:broader skos:narrower skos:related skos:inScheme skos:topConceptOf skos:hasTopConcept prov:wasGeneratedBy prov:wasAttributedTo prov:wasDerivedFrom".split()
LINK_SET_TERMS = "okf:dependsOn okf:references okf:implements".split()
ENGINE = "urn:okf:agent:okf-engine"
OPTIONAL = {"attester": "string", "sources": "array<string>", "generated": "string", "computation": "string", "quality": "long"}


def context() -> str:
    """The context that the nodes are read with, as JSON."""
    name = lambda term: term.split(":")[1]
    found: dict = {"@version": 1.1, **NAMESPACES}
    found |= {name(t): t for t in PLAIN_TERMS}
    found |= {name(t): {"@id": t, "@language": "en"} for t in ENGLISH_TERMS}
    found |= {name(t): {"@id": t, "@type": "@id"} for t in LINK_TERMS}
    found |= {name(t): {"@id": t, "@type": "@id", "@container": "@set"} for t in LINK_SET_TERMS}
    found |= {"altLabel": {"@id": "skos:altLabel", "@container": "@set"}, "generatedAtTime": {"@id": "prov:generatedAtTime", "@type": "xsd:dateTime"}}
    return json.dumps(found)


def concept_uri(key: Column) -> Column:
    return F.concat(F.lit("urn:okf:concept:"), key)


def encoded(c: Column) -> Column:
    """A value as a component of an address: letters, digits and - _ . ! ~ * ' ( ) stay."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def _targets(edges: DataFrame) -> DataFrame:
    """The addresses that each concept links to, by kind, each once and in order."""
    uri = concept_uri(F.col("dst"))
    of = lambda *kinds: F.array_sort(F.collect_set(F.when(F.col("kind").isin(*kinds), uri)))
    return edges.groupBy(F.col("src").alias("id")).agg(of("depends_on").alias("depends"), of("references").alias("refs"), of("implements").alias("impls"), of("references", "related_to").alias("related"))


def top_concepts(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the concepts that no link leads to; if all are linked to, the first by id."""
    tops = concepts.select("id").join(edges.select(F.col("dst").alias("id")), "id", "left_anti").distinct()
    # One row each: the first id, and whether there is any top.
    spare = concepts.agg(F.min("id").alias("id")).join(tops.agg(F.count("*").alias("n"))).where("n = 0 AND id IS NOT NULL").select("id")
    return tops.unionAll(spare)


def provenance_nodes(concepts: DataFrame, edges: DataFrame, bundle: str, now: str, version: str = "0.2.0") -> DataFrame:
    """(node, kind, json): the graph's nodes, of kind scheme, top, concept or activity.

    concepts: id, title, description, type, tags, body, trust_tier, and as far as known attester,
    sources, generated, computation, quality; edges: src, dst, kind. What a concept depends on is
    broader; what it references or relates to is related. A concept with any word on its making
    names an activity. The scheme's top concepts are nodes of the scheme's own address, one for each, as a list of
    all would be one row that grows with the bundle; readers of linked data merge them. Repeated
    links count once. Missing titles are the id. Nothing comes of concepts without id.
    """
    known = concepts.select(*concepts.columns, *(F.lit(None).cast(t).alias(n) for n, t in OPTIONAL.items() if n not in concepts.columns)).where("id IS NOT NULL")
    slug = F.regexp_replace(F.lower(F.lit(bundle or "okf-enterprise")), "[^a-zA-Z0-9_-]", "-")
    scheme = F.concat(F.lit("urn:okf:scheme:"), slug)
    tops = top_concepts(known, edges)
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    made = said("attester").isNotNull() | F.col("sources").isNotNull() | said("generated").isNotNull() | said("computation").isNotNull()
    activity = F.when(made, F.concat(F.lit("urn:okf:activity:"), F.regexp_replace("id", "[^a-zA-Z0-9_.-]", "_"), F.lit(":generation")))
    full = known.join(_targets(edges), "id", "left").join(tops.withColumn("top", F.lit(True)), "id", "left").withColumn("activity", activity)
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    tags = F.coalesce("tags", F.expr("cast(array() as array<string>)"))
    types = lambda *names: F.array(*(F.lit(n) for n in names))
    concept = F.struct(
        concept_uri(F.col("id")).alias("@id"), types("skos:Concept", "prov:Entity", "schema:TechArticle", "okf:Concept").alias("@type"), scheme.alias("inScheme"),
        F.coalesce(said("title"), F.col("id")).alias("prefLabel"), F.coalesce(said("description"), F.concat(F.lit("Concept definition for "), "id")).alias("definition"),
        F.col("id").alias("dc:identifier"), F.coalesce(said("type"), F.lit("concept")).alias("dc:type"), F.lit("text/markdown").alias("dc:format"), tags.alias("schema:keywords"), F.coalesce("body", F.lit("")).alias("schema:articleBody"),
        F.coalesce(said("type"), F.lit("concept")).alias("conceptType"), F.col("trust_tier").alias("trustTier"), F.coalesce(F.nullif("quality", F.lit(0)), F.lit(100)).alias("qualityScore"), F.when(F.size(tags) > 0, tags).alias("altLabel"), F.when(F.col("top"), scheme).alias("topConceptOf"),
        some("depends").alias("broader"), some("depends").alias("dependsOn"), some("related").alias("related"), some("refs").alias("references"), some("impls").alias("implements"), F.col("activity").alias("wasGeneratedBy"),
    )
    agent = F.when(
        said("attester").isNotNull(), F.struct(F.concat(F.lit("urn:okf:attester:"), encoded(F.col("attester"))).alias("@id"), F.lit("prov:Agent").alias("@type"), F.col("attester").alias("schema:name"))
    ).otherwise(F.struct(F.lit(ENGINE).alias("@id"), F.lit("prov:SoftwareAgent").alias("@type"), F.lit("OKF Deterministic Validator").alias("schema:name")))
    act = F.struct(
        F.col("activity").alias("@id"), F.lit("prov:Activity").alias("@type"), F.concat(F.lit("Generation and verification of "), "id").alias("rdfs:label"), F.coalesce(said("generated"), F.lit(now)).alias("generatedAtTime"),
        agent.alias("prov:wasAssociatedWith"), F.transform("sources", lambda s: F.concat(F.lit("urn:okf:source:"), encoded(s))).alias("prov:used"),
    )
    name = bundle or "OKF Enterprise Knowledge Base"
    owner = F.struct(F.lit(ENGINE).alias("@id"), types("prov:SoftwareAgent", "schema:SoftwareApplication").alias("@type"), F.lit("OKF Semantic Knowledge Engine v0.2").alias("schema:name"))
    root = F.struct(
        scheme.alias("@id"), types("skos:ConceptScheme", "owl:Ontology", "schema:DataCatalog").alias("@type"), F.lit(name).alias("dc:title"), F.lit(f"Enterprise Knowledge Graph for {name} governed by OKF v0.2 specification.").alias("dc:description"),
        F.lit(now).alias("dcterms:created"), F.lit(now).alias("dcterms:modified"), F.lit(version).alias("owl:versionInfo"), owner.alias("prov:wasAttributedTo"),
    )
    one = concepts.sparkSession.range(1).select(scheme.alias("node"), F.lit("scheme").alias("kind"), F.to_json(root).alias("json"))
    per_top = tops.select(scheme.alias("node"), F.lit("top").alias("kind"), F.to_json(F.struct(scheme.alias("@id"), concept_uri(F.col("id")).alias("hasTopConcept"))).alias("json"))
    # A concept and its activity are written in one pass over the joined rows.
    rows = F.array(F.struct(concept_uri(F.col("id")).alias("node"), F.lit("concept").alias("kind"), F.to_json(concept).alias("json")), F.struct(F.col("activity").alias("node"), F.lit("activity").alias("kind"), F.to_json(act).alias("json")))
    each = full.select(F.explode(rows).alias("x")).select("x.*").where("node IS NOT NULL")
    return one.unionAll(per_top).unionAll(each)
