"""Command line: ast, chunk, links, lint, search, sparql and export over a folder of Markdown files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import markdown, quality, retrieval, slicing, sparql
from marlstone.session import build_session
from marlstone.sources import readers, sinks


def load(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path, text) of the files below a folder; ids are hashes of the paths."""
    return readers.read_files(spark, folder).where("text != ''").select(F.xxhash64("path").alias("doc_id"), "path", "text")


def concepts(docs: DataFrame) -> DataFrame:
    """The columns that validators, retrieval and exports take, from the documents' sections."""
    cut = markdown.concepts(docs)
    return cut.withColumns({"verified": F.lit(""), "computation": F.lit(""), "runtime": F.lit(""), "stale_after": F.col("stale_after").cast("string")})


def links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Edges between concepts whose documents link each other's titles."""
    named = found.select("id", T.clean_id(F.col("title")).alias("name"))
    out = markdown.wikilinks(docs).select("doc_id", T.clean_id(F.col("target")).alias("name"))
    first = found.groupBy("doc_id").agg(F.min("id").alias("src"))
    return out.join(named.withColumnRenamed("id", "dst"), "name").join(first, "doc_id").where("src != dst").select("src", "dst", F.lit("references").alias("kind")).distinct()


def run(args: argparse.Namespace, spark: SparkSession) -> DataFrame:
    docs = load(spark, args.folder)
    if args.command == "ast":
        return markdown.with_breadcrumbs(markdown.blocks(docs)).drop("raw")
    if args.command == "chunk":
        return markdown.chunks(docs, most_tokens=args.tokens)
    if args.command == "links":
        return markdown.wikilinks(docs)
    found = concepts(docs)
    if args.command == "lint":
        return quality.document_issues(found, args.as_of)
    if args.command == "skills":
        skills, references = slicing.skill_packages(docs)
        scripts = slicing.executable_scripts(markdown.blocks(docs)).select(F.substring(F.concat(F.lit("doc-"), "doc_id"), 1, 64).alias("name"), "language", F.col("code").alias("content"))
        return slicing.practice_audit(skills, references, scripts)
    if args.command == "search":
        return retrieval.keyword_search(found, args.query, args.limit or 20)
    if args.command == "sparql":
        return sparql.run(sparql.triples(found, links(docs, found)), args.query)
    return sinks.export(found, links(docs, found), args.kind)


def main() -> None:
    parser = argparse.ArgumentParser(prog="marlstone", description=__doc__)
    parser.add_argument("command", choices=["ast", "chunk", "links", "lint", "skills", "search", "sparql", "export"])
    parser.add_argument("folder")
    parser.add_argument("--query", default="")
    parser.add_argument("--kind", default="turtle")
    parser.add_argument("--tokens", type=int, default=512)
    parser.add_argument("--limit", type=int, help="rows to print; search prints 20 if it is not given")
    parser.add_argument("--as-of", default="2026-01-01")
    args = parser.parse_args()
    spark = build_session()
    found = run(args, spark)
    for row in (found if args.limit is None else found.limit(args.limit)).toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()
