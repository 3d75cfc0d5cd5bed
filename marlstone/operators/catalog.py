"""Operators on catalogs of documents: filters, selections, queue and crawl totals, activation, whole bundles."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import graph, markdown, quality
from marlstone.sources import sinks


def matches_any(query: str, scalars: tuple[str, ...], arrays: tuple[str, ...] = ()) -> Column:
    """Whether one of the columns, or an element of one of the arrays, holds the query, whatever its case.

    Null columns hold nothing; a blank query matches every row.
    """
    q = query.strip().lower()
    if not q:
        return F.lit(True)
    has = [F.coalesce(F.lower(F.col(c).cast("string")).contains(q), F.lit(False)) for c in scalars]
    has += [F.coalesce(F.exists(F.col(c), lambda x: F.lower(x).contains(q)), F.lit(False)) for c in arrays]
    return reduce(or_, has)


def filtered(docs: DataFrame, query: str = "", scalars: tuple[str, ...] = ("title", "description", "body"), arrays: tuple[str, ...] = ("tags",), **equal: str) -> DataFrame:
    """Documents that match the query in any field and whose columns have the given values ('all': any)."""
    kept = docs.where(matches_any(query, scalars, arrays))
    for name, value in equal.items():
        if value != "all":
            kept = kept.where(F.array_contains(name, value) if dict(docs.dtypes)[name].startswith("array") else F.lower(name) == value.lower())
    return kept


def selected(docs: DataFrame, chosen: DataFrame, id_col: str = "id") -> DataFrame:
    """The documents whose ids are chosen; all of them where no chosen id is left among them."""
    held = docs.join(chosen.select(id_col).distinct(), id_col, "left_semi")
    any_left = held.limit(1).agg((F.count("*") > 0).alias("some"))
    flagged = docs.join(chosen.select(id_col).distinct().withColumn("is_chosen", F.lit(True)), id_col, "left")
    return flagged.join(F.broadcast(any_left)).where(F.col("is_chosen") | ~F.col("some")).select(*docs.columns)


def queue_status(queue: DataFrame) -> DataFrame:
    """One row of counts by status, and the share in per cent that is done; working statuses are those of conversion."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    done = n("success", "error")
    share = F.when(F.count("*") > 0, T.half_up(100 * done / F.count("*"))).otherwise(0)
    return queue.agg(
        F.count("*").alias("n_total"), n("success").alias("n_success"), n("error").alias("n_error"), n("pending").alias("n_pending"),
        n("converting_markdown", "formatting_okf").alias("n_working"), share.cast("long").alias("progress"),
    )


def crawl_totals(pages: DataFrame, domain: Column) -> DataFrame:
    """(domain, n_pages, n_words, deepest) of crawled pages (words, depth)."""
    return pages.groupBy(domain.alias("domain")).agg(F.count("*").alias("n_pages"), F.sum("words").cast("long").alias("n_words"), F.max("depth").alias("deepest"))


def activation(skills: DataFrame, query: str) -> DataFrame:
    """(name, activates, confidence): how many of the query's words a skill's description or name holds."""
    q = query.lower()
    words = [w for w in re.split(r"\s+", q) if len(w) > 2]
    d, n = F.lower(F.coalesce("description", F.lit(""))), F.lower(F.coalesce("name", F.lit("")))
    hits = sum(((d.contains(w) | n.contains(w)).cast("int") for w in words), F.lit(0))
    share = hits / len(words) if words else F.lit(0.0)
    whole = d.contains(q)
    confidence = F.least(F.lit(100), T.half_up(100 * share + F.when(whole, 50).otherwise(0))).cast("long")
    return skills.select("name", ((share > 0.3) | whole).alias("activates"), confidence.alias("confidence"))


def carried_tails(pages: DataFrame, group: str, order: str, text: Column, chars: int = 400) -> DataFrame:
    """Pages with ``context``: the last characters of the page before, which a converter reads ahead of its own."""
    before = F.lag(text).over(Window.partitionBy(group).orderBy(order))
    return pages.withColumn("context", F.coalesce(F.right(before, F.lit(chars)), F.lit("")))


def carried_lines(pages: DataFrame, group: str, order: str, text: Column, lines: int = 15) -> DataFrame:
    """Pages with ``context``: the last lines of the page before."""
    before = F.split(F.lag(text).over(Window.partitionBy(group).orderBy(order)), "\n")
    return pages.withColumn("context", F.coalesce(F.array_join(F.slice(before, F.greatest(F.lit(1), F.size(before) - lines + 1), F.lit(lines)), "\n"), F.lit("")))


def unselected(docs: DataFrame, chosen: DataFrame, id_col: str = "id") -> DataFrame:
    """The documents whose ids are not chosen."""
    return docs.join(chosen.select(id_col), id_col, "left_anti")


def tag_union(one: Column, two: Column, most: int = 8) -> Column:
    """The distinct tags of both, in order, ``most`` at most; null lists count as empty."""
    none = F.expr("cast(array() as array<string>)")
    return F.slice(F.array_union(F.coalesce(one, none), F.coalesce(two, none)), 1, most)


def provenance_total(sources: Column) -> Column:
    """The sum of sources over concepts; one without a source counts one."""
    return F.sum(F.when(F.size(sources) > 0, F.size(sources)).otherwise(1)).cast("long")


def edge_titles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, kind, src_title, dst_title): titles of both ends, or the id where there is none."""
    named = lambda end: nodes.select(F.col("id").alias(end), F.col("title").alias(f"{end}_title"))
    both = edges.join(named("src"), "src", "left").join(named("dst"), "dst", "left")
    return both.select("src", "dst", "kind", F.coalesce("src_title", "src").alias("src_title"), F.coalesce("dst_title", "dst").alias("dst_title"))


def shown_edges(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = (), types: tuple[str, ...] = ()) -> DataFrame:
    """Edges of the given kinds between nodes of the given types (none given: any); both ends must exist."""
    kept = nodes.where(F.col("type").isin(*types)) if types else nodes
    some = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    return some.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, prerequisites, related): what each node depends on, and what other edges lead to, in order of id."""
    needs = F.array_sort(F.collect_set(F.when(F.col("kind") == "depends_on", F.col("dst")))).alias("prerequisites")
    others = F.array_sort(F.collect_set(F.when(F.col("kind") != "depends_on", F.col("dst")))).alias("related")
    none = F.expr("cast(array() as array<string>)")
    found = edges.groupBy(F.col("src").alias("id")).agg(needs, others)
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("prerequisites", none).alias("prerequisites"), F.coalesce("related", none).alias("related"))


def top_concepts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge ends in; the first by id where there are none."""
    top = nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id")
    first = nodes.orderBy("id").limit(1).select("id").join(F.broadcast(top.limit(1).agg((F.count("*") == 0).alias("empty")))).where("empty").select("id")
    return top.unionAll(first)


def bundle_issues(concepts: DataFrame, links: DataFrame, as_of: str) -> DataFrame:
    """(id, code, severity) of a whole bundle: those of its documents, links to nothing, cycles of needs, and repeated paths."""
    own = quality.document_issues(concepts, as_of)
    issue = lambda df, code, severity: df.select("id", F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    ids = concepts.select(F.col("id").alias("dst"))
    broken = links.join(ids, "dst", "left_anti").select(F.col("src").alias("id"))
    alive = links.join(ids, "dst", "left_semi").where("kind = 'depends_on'")
    again = concepts.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    twice = concepts.join(again, "path", "left_semi").select("id")
    return own.unionAll(issue(broken, "WARN_BROKEN_LINK", "warning")).unionAll(issue(graph.cyclic_nodes(alive), "ERR_DEPENDENCY_CYCLE", "error")).unionAll(issue(twice, "ERR_DUPLICATE_PATH", "error"))


def analysed(docs: DataFrame, id_col: str = "doc_id", title: str = "title", text_col: str = "text") -> DataFrame:
    """(doc_id, type, flesch, ambiguity, completeness, procedural, target, tags): the analysis of each concept in one row.

    Tags are the subject's and then the type, eight at most.
    """
    t, name = F.col(text_col), F.col(title)
    # Each of these is read more than once below: a column of its own is worked out once.
    known = docs.select(F.col(id_col).alias("doc_id"), t.alias("_t"), name.alias("_name"), T.concept_type(name, t).alias("type"), quality.procedural_score(t).alias("_score"))
    t, name = F.col("_t"), F.col("_name")
    q = T.content_quality(t)
    logic = quality.logic_class(t, F.col("_score"))
    tags = tag_union(T.subject_tags(name, t), F.array("type"))
    return known.select("doc_id", "type", T.readability(t)["flesch"].alias("flesch"), q["ambiguity"].alias("ambiguity"), q["completeness"].alias("completeness"), logic["procedural"].alias("procedural"), logic["target"].alias("target"), tags.alias("tags"))


def bundle_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_of: str = "2026-01-01") -> DataFrame:
    """(path, text): the files of a bundle of many documents.

    Each document is cut to concepts of its own, with a header; every type has an index of links,
    and every document a line of the log. Files of one path from different documents are told
    apart by the document's id.
    """
    cut = markdown.concepts(docs, id_col, text_col, as_of=as_of)
    path = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("/"), "path")
    none = F.expr("cast(array() as array<string>)")
    files = cut.select(path.alias("path"), F.concat(markdown.frontmatter(F.col("type"), F.col("title"), F.col("description"), F.col("tags"), none), F.lit("\n\n# "), "title", F.lit("\n\n"), "body").alias("text"))
    index = sinks.vault_index(cut.withColumn("path", path)).select(F.concat(F.lit("index/"), "type", F.lit(".md")).alias("path"), F.col("index").alias("text"))
    line = F.concat(F.lit(f"- {as_of}: document "), F.col("doc_id").cast("string"), F.lit(", "), F.count("*").cast("string"), F.lit(" concepts"))
    log = cut.groupBy("doc_id").agg(line.alias("text")).select(F.concat(F.lit("log/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return files.unionAll(index).unionAll(log)
