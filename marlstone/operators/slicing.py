"""Slicing of long documents: concepts with woven links, assets and scripts taken out, skill packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import markdown, quality

# Verbs in titles of procedures, openings of such titles, marks of reference texts, and scopes by words of a title.
ACTION_VERBS = (
    "deploy", "install", "configure", "setup", "initialize", "migrate",
    "build", "run", "execute", "verify", "validate", "test", "audit",
    "troubleshoot", "rollback", "restore", "backup", "monitor", "scale",
    "provision", "connect", "authenticate", "authorize", "clean", "format",
)
PROCEDURE_TITLE = r"(?i)^(step\s*\d+|phase\s*\d+|part\s*\d+|workflow|procedure|runbook|checklist|instructions|actions)"
ERROR_CODES = r"(?i)error\s*code|status\s*code|http\s*\d{3}|err_|exception"
_WEIGHTS = ((r"(?i)law|statut|regulation|compliance", 100), (r"(?i)policy|standard|agreement", 80), (r"(?i)guide|procedure|process", 50))


def precedence_weight(title: Column) -> Column:
    out = None
    for pattern, weight in _WEIGHTS:
        out = F.when(title.rlike(pattern), weight) if out is None else out.when(title.rlike(pattern), weight)
    return out.otherwise(30)


def sliced_concepts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, title, slug, type, weight, body): sections of the first two levels, or of three where those give one at most and the text is long."""
    two = markdown.sections(docs, id_col, text_col, deepest=2)
    three = markdown.sections(docs, id_col, text_col, deepest=3)
    lines = docs.select(F.col(id_col).alias("doc_id"), F.size(F.split(text_col, "\n")).alias("n_lines"))
    few = two.groupBy("doc_id").agg(F.count("*").alias("n")).join(lines, "doc_id").where("n <= 1 AND n_lines > 30").select("doc_id")
    cut = two.join(few, "doc_id", "left_anti").unionByName(three.join(few, "doc_id", "left_semi")).where(F.trim("content") != "")
    return cut.select("doc_id", "section", "title", T.slug_ascii(F.col("title")).alias("slug"), T.section_type(F.col("title"), F.col("content")).alias("type"), precedence_weight(F.col("title")).alias("weight"), F.col("content").alias("body"))


def with_wikilinks(concepts: DataFrame, most: int = 4) -> DataFrame:
    """Concepts whose bodies link the first mention of other titles of their document, outside code.

    Titles are gathered by document, so a body meets only the titles of its own document.
    """
    titles = F.collect_list(F.when(F.length("title").between(4, 60), F.struct("title", "slug"))).over(Window.partitionBy("doc_id"))
    others = F.filter("titles", lambda t: (t["slug"] != F.col("slug")) & F.lower("body").contains(F.lower(t["title"])))
    code = F.regexp_extract_all("body", F.lit(T.FENCED), F.lit(0))
    prose = F.split("body", T.FENCED)

    def woven(part: Column) -> Column:
        quoted = lambda t: F.concat(F.lit(r"(?i)(?<![\[\w`])(\Q"), t["title"], F.lit(r"\E)(?![\]\w`])"))
        return F.aggregate("others", part, lambda text, t: F.regexp_replace(text, quoted(t), F.concat(F.lit("[["), t["slug"], F.lit("|$1]]"))))

    # Pieces of prose and the fences between them, in turn.
    joined = F.array_join(F.transform("prose", lambda p, i: F.concat(woven(p), F.coalesce(F.get("code", i), F.lit("")))), "")
    return concepts.withColumn("titles", titles).withColumn("others", F.slice(others, 1, most)).withColumns({"code": code, "prose": prose}).withColumn("body", joined).drop("titles", "others", "code", "prose")


def asset_references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, assets, saved_bytes): embedded images become references to numbered files."""
    pattern = r"data:image/([a-zA-Z0-9.+-]+);base64,[A-Za-z0-9+/=\s]*[A-Za-z0-9+/=]"
    found = F.regexp_extract_all(F.col(text_col), F.lit("(" + pattern + ")"), F.lit(1))
    kinds = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))
    ending = lambda k: F.when(F.lower(k) == "jpeg", "jpg").when(F.lower(k) == "svg+xml", "svg").otherwise(F.lower(k))
    names = F.transform("kinds", lambda k, i: F.concat(F.lit("assets/"), F.col("doc_id"), F.lit("-"), (i + 1).cast("string"), F.lit("."), ending(k)))
    text = F.array_join(F.transform(F.split(text_col, pattern, -1), lambda p, i: F.concat(p, F.coalesce(F.get("assets", i), F.lit("")))), "")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col), found.alias("found"), kinds.alias("kinds")).withColumn("assets", names)
    saved = F.aggregate("found", F.lit(0), lambda s, x: s + F.length(x))
    return base.select("doc_id", text.alias("text"), "assets", saved.cast("long").alias("saved_bytes"))


def executable_scripts(blocks: DataFrame, least_lines: int = 8) -> DataFrame:
    """(doc_id, ord, language, path, code) of fenced scripts that are long, open with #! or are longer SQL."""
    n = F.size(F.split("content", "\n"))
    runs = F.col("language").isin("bash", "sh", "shell", "zsh", "python", "py", "javascript", "js", "typescript", "ts", "ruby", "sql")
    kept = blocks.where((F.col("kind") == "code_block") & (((n >= least_lines) & runs) | F.col("content").startswith("#!") | ((F.col("language") == "sql") & (n >= 5))))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    ending = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in {"bash": "sh", "shell": "sh", "zsh": "sh", "python": "py", "javascript": "js", "typescript": "ts", "ruby": "rb"}.items() for x in kv)), F.col("language")), F.col("language"))
    return kept.select("doc_id", "ord", "language", F.concat(F.lit("scripts/"), F.col("doc_id"), F.lit("-"), number, F.lit("."), ending).alias("path"), F.col("content").alias("code"))


def is_procedural(title: Column, body: Column) -> Column:
    """By the title's opening or a verb in it, or, of texts of over 20 characters, by the logic score."""
    low = F.lower(title)
    named = low.rlike(PROCEDURE_TITLE) | F.exists(F.array(*(F.lit(v) for v in ACTION_VERBS)), lambda v: low.contains(v))
    return named | ((F.length(body) > 20) & (quality.logic_class(body)["procedural"] >= 45))


def is_reference_heavy(body: Column) -> Column:
    """Long texts with more than ten rows of tables, or with error codes."""
    rows = F.regexp_count(body, F.lit(r"\|.*\|"))
    return (F.size(F.split(body, r"\s+")) > 400) & ((rows > 10) | body.rlike(ERROR_CODES))


def skill_packages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Skills (name, description, body) of the procedural sections, and their references (name, path, content)."""
    cut = markdown.sections(docs, id_col, text_col, deepest=3).where(F.trim("content") != "")
    rated = cut.withColumn("procedural", is_procedural(F.col("title"), F.col("content")) & ~is_reference_heavy(F.col("content")))
    name = F.substring(F.concat(F.lit("doc-"), F.col("doc_id")), 1, 64)
    path = F.concat(F.lit("references/"), T.slug_ascii(F.col("title")), F.lit("-"), F.col("section"), F.lit(".md"))
    references = rated.where("NOT procedural").select(name.alias("name"), path.alias("path"), F.concat(F.lit("# "), "title", F.lit("\n\n"), "content").alias("content"))
    steps = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("procedural"), F.struct("section", F.concat(F.lit("## "), "title", F.lit("\n"), "content").alias("t"))))), lambda x: x["t"]), "\n\n")
    links = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("procedural"), F.struct("section", F.concat(F.lit("- ["), "title", F.lit("]("), path, F.lit(")")).alias("t"))))), lambda x: x["t"]), "\n")
    skills = rated.groupBy(name.alias("name")).agg(F.min_by("title", "section").alias("first"), steps.alias("steps"), links.alias("links"))
    return skills.select("name", F.concat(F.lit("Use when working on "), "first").alias("description"), F.concat_ws("\n\n", F.concat(F.lit("# "), "first"), "steps", F.when(F.col("links") != "", F.concat(F.lit("## References\n"), "links"))).alias("body")), references


def typed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ord, kind, content): the sections of a document as typed blocks of its container form."""
    cut = markdown.sections(docs, id_col, text_col).where(F.trim("content") != "")
    body = F.col("content")
    kind = F.when(body.rlike(T.TABLE_RULE), "table").when(body.rlike(r"(?m)^```"), "code").when(body.rlike(r"(?m)^\s*\d+\.\s"), "procedure").when(body.rlike(r"(?m)^\s*>"), "quote").otherwise("text")
    return cut.select("doc_id", F.col("section").alias("ord"), kind.alias("kind"), "title", body.alias("content"))


def container_text(blocks: DataFrame, style: str = "directive") -> DataFrame:
    """(doc_id, text): typed blocks between directive, comment or heading marks."""
    left, right = {"comment": ("<!-- block:", " -->\n"), "heading": ("## [", "]\n")}.get(style, (":::", "\n"))
    close = {"comment": "\n<!-- end -->", "heading": ""}.get(style, "\n:::")
    one = F.concat(F.lit(left), "kind", F.lit(right), "content", F.lit(close))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def container_score(text: Column) -> Column:
    """100 less 40 without a header, 30 without a type, 10 without a title, and 10 for each block left open."""
    header = text.rlike(r"(?s)^---\n.*?\n---")
    opened, closed = F.regexp_count(text, F.lit(r"(?m)^:::[a-z]")), F.regexp_count(text, F.lit(r"(?m)^:::\s*$"))
    score = 100 - F.when(header, 0).otherwise(40) - F.when(text.rlike(r"(?m)^type\s*:"), 0).otherwise(30) - F.when(text.rlike(r"(?m)^title\s*:"), 0).otherwise(10) - 10 * F.greatest(F.lit(0), opened - closed)
    return F.greatest(F.lit(0), score).cast("long")


# The forms that the checks look for.
TRIGGERS = r"(?i)use\s+when|when\s+instructed|when\s+handling|triggers:|trigger:|activate\s+when|applicable\s+when"
NUMBERED = r"(?i)(?:###?\s*(?:Step\s*\d+|\d+\.|\d+\))\s+[A-Z]|(?:^|\n)\s*1\.\s+)"
VERIFIES = r"(?i)(?:verification|verify|validation|validate|check|confirm|expected\s+output)"
RECOVERS = r"(?i)(?:troubleshooting|error\s+recovery|rollback|fallback|failure|diagnostics)"
REFERENCE_LINK = r"\[.*?\]\(\./(references/[a-zA-Z0-9_\-./]+\.md)\)"


def practice_audit(skills: DataFrame, references: DataFrame, scripts: DataFrame) -> DataFrame:
    """(name, score, grade, is_compliant, checks): the mean of ten checks of a skill, from 0 to 100.

    skills: name, description, body; references: name, path, content; scripts: name, language,
    content. Names are unique. Missing texts count as empty ones.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    secret = lambda c: text(c).rlike(quality.SECRETS["generic_key"])
    files = references.groupBy("name").agg(F.count("*").alias("n_refs"), F.sum(T.estimate_tokens(text("content"))).alias("ref_tokens"), F.max(secret("content")).alias("ref_secret"))
    bash = F.col("language") == "bash"
    headed = text("content").contains("#!/usr/bin/env bash") | text("content").contains("#!/bin/bash")
    strict = text("content").contains("set -e")
    runs = scripts.groupBy("name").agg(F.sum(T.estimate_tokens(text("content"))).alias("script_tokens"), F.max(secret("content")).alias("script_secret"), F.count_if(bash & ~(headed & strict)).alias("loose"))
    links = skills.select("name", F.explode(F.regexp_extract_all("body", F.lit(REFERENCE_LINK), F.lit(1))).alias("path"))
    broken = links.join(references.select("name", "path").distinct(), ["name", "path"], "left_anti").groupBy("name").agg(F.count("*").alias("n_broken"))
    every = skills.select("name", text("description").alias("d"), text("body").alias("b")).join(files, "name", "left").join(runs, "name", "left").join(broken, "name", "left")
    every = every.fillna(0, ["n_refs", "ref_tokens", "script_tokens", "loose", "n_broken"]).fillna(False, ["ref_secret", "script_secret"]).withColumn("tokens", T.estimate_tokens(F.col("b")))
    c = F.col
    total = c("tokens") + c("ref_tokens") + c("script_tokens")
    named = c("name").rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$") & (F.length("name") <= 64)
    described, triggered = F.length("d").between(10, 1024), c("d").rlike(TRIGGERS)
    clean = ~(c("b").rlike(quality.SECRETS["generic_key"]) | c("ref_secret") | c("script_secret"))
    either = lambda ok, low: F.when(ok, 100).otherwise(low)
    checks = {
        "BP-NAME-FORMAT": (either(named, 0), named), "BP-DESC-TRIGGERS": (F.when(described, either(triggered, 65)).otherwise(30), described & triggered),
        "BP-PROGRESSIVE-DISCLOSURE": (F.when(c("tokens") <= 3500, 100).when(c("tokens") <= 5000, 75).otherwise(20), c("tokens") <= 5000),
        "BP-JIT-REFERENCES": (F.when(c("n_refs") > 0, 100).when(total < 1500, 90).otherwise(60), (c("n_refs") > 0) | (total < 1500)),
        "BP-ACTIONABLE-STEPS": (either(c("b").rlike(NUMBERED), 50), c("b").rlike(NUMBERED)), "BP-VERIFICATION-CHECKS": (either(c("b").rlike(VERIFIES), 40), c("b").rlike(VERIFIES)),
        "BP-ERROR-ROLLBACK": (either(c("b").rlike(RECOVERS), 50), c("b").rlike(RECOVERS)), "BP-SCRIPT-STANDARDS": (either(c("loose") == 0, 70), c("loose") == 0),
        "BP-SECURITY-SECRETS": (either(clean, 0), clean), "BP-LINK-INTEGRITY": (either(c("n_broken") == 0, 0), c("n_broken") == 0),
    }
    rated = every.select("name", F.array(*(F.struct(F.lit(k).alias("id"), s.cast("long").alias("score"), ok.alias("passed")) for k, (s, ok) in checks.items())).alias("checks"))
    score = T.half_up(F.aggregate("checks", F.lit(0).cast("long"), lambda s, x: s + x["score"]) / len(checks)).cast("long")
    grade = F.when(score >= 95, "A+").when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").otherwise("F")
    # What counts as an error where it fails.
    errors = ("BP-NAME-FORMAT", "BP-PROGRESSIVE-DISCLOSURE", "BP-SECURITY-SECRETS", "BP-LINK-INTEGRITY")
    fails = F.exists("checks", lambda x: ~x["passed"] & x["id"].isin(*errors))
    return rated.select("name", score.alias("score"), grade.alias("grade"), ((score >= 80) & ~fails).alias("is_compliant"), "checks")
