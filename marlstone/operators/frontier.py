"""Semantic crawls of many sites at once: ranked links, robots, a budget of pages for each site, and the merged document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import web
from marlstone.session import durable


def candidate_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, link, ord): the distinct pages that a page's anchors lead to, by the place of the first one."""
    href = r"""(?i)<a\b[^>]*href=["']([^"']+)["'][^>]*>"""
    each = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    placed = each.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(href), F.lit(1))).alias("ord", "href"))
    # The rules of web.page_links, with places.
    one = placed.select("url", "ord", web.without_tracking(web.resolved(F.trim("href"), F.col("url"))).alias("link"), F.trim("href").alias("href"))
    kept = one.where(~F.col("href").rlike(r"^(?:#|javascript:|mailto:|tel:|$)") & web.is_page_url(F.col("link")) & (web.host(F.col("link")) == web.host(F.col("url"))))
    skipped = F.lower("link").rlike("|".join(web.SKIPPED_PARTS))
    return kept.where(~skipped).groupBy("url", "link").agg(F.min("ord").alias("ord"))


def focus_score(link: Column, page: Column, focus: str = "") -> Column:
    """Segments of the path that a link shares with its page from the root, and 2 for each word of the focus in its address."""
    parts = lambda u: F.split(web.path(u), "/")
    shared = F.size(F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts(page)))), lambda n: F.slice(parts(link), F.lit(1), n) == F.slice(parts(page), F.lit(1), n)))
    score = shared.cast("double")
    for word in sorted(set(focus.lower().split())):
        score = score + F.when(F.lower(link).contains(word), 2.0).otherwise(0.0)
    return score


def _visited(level: DataFrame, before: DataFrame | None, pages: DataFrame, rules: DataFrame, agent: str, most_pages: int) -> DataFrame:
    """The rows of a level that are reached within the budget, with status and the number of pages so far."""
    there = pages.select("url").join(level.select("url"), "url", "left_semi").distinct().withColumn("there", F.lit(True))
    allowed = web.allowed_by_robots(level.select("url").distinct(), rules, agent)
    judged = level.join(there, "url", "left").join(allowed, "url", "left")
    judged = judged.withColumn("status", F.when(~F.coalesce("allowed", F.lit(True)), "skipped").when(F.col("there"), "success").otherwise("failed"))
    done = F.lit(0).cast("long")
    if before is not None:
        judged = judged.join(before.groupBy("site").agg(F.count_if(F.col("status") == "success").alias("earlier")), "site", "left")
        done = F.coalesce("earlier", done)
    # A level has at most per_page rows for each page of the budget, so a site's window is bounded by parameters.
    run = Window.partitionBy("site").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("status") == "success").cast("long")
    counted = judged.withColumn("n_pages", done + F.sum(hit).over(run)).where(F.col("n_pages") - hit < most_pages)
    return counted.select("site", "prefix", "url", "depth", "place", "parent", "status", "n_pages")


def _chosen(level: DataFrame, found: DataFrame, links: DataFrame, per_page: int) -> DataFrame:
    """(site, prefix, url, parent, place): what the pages of a level add to the queue, one after the other.

    A page takes the ``per_page`` best links that nothing before it has queued. Pages before it in
    its level take at most ``per_page`` each, so the best ``per_page * n`` links of the n-th page
    hold all that it can take, and the rest needs not travel.
    """
    turn = F.row_number().over(Window.partitionBy("site").orderBy("place"))
    open_pages = level.withColumn("turn", turn).select("site", "prefix", "url", "turn")
    met = links.join(open_pages, "url").where((F.col("prefix") == "") | F.startswith(web.path(F.col("link")), F.col("prefix")))
    fresh = met.join(found.select("site", F.col("url").alias("link")), ["site", "link"], "left_anti")
    best = F.row_number().over(Window.partitionBy("site", "turn").orderBy(F.desc("score"), "ord", "link"))
    cut = fresh.withColumn("best", best).where(F.col("best") <= per_page * F.col("turn"))
    lists = cut.groupBy("site", "prefix", "turn", "url").agg(F.transform(F.array_sort(F.collect_list(F.struct("best", "link"))), lambda x: x["link"]).alias("links"))
    queues = lists.groupBy("site", "prefix").agg(F.array_sort(F.collect_list(F.struct("turn", "url", "links"))).alias("turns"))
    empty = F.expr("named_struct('seen', cast(array() as array<string>), 'taken', cast(array() as array<struct<url: string, parent: string>>))")

    def take(state: Column, page: Column) -> Column:
        new = F.slice(F.array_except(page["links"], state["seen"]), 1, per_page)
        rows = F.transform(new, lambda u: F.struct(u.alias("url"), page["url"].alias("parent")))
        return F.struct(F.concat(state["seen"], new).alias("seen"), F.concat(state["taken"], rows).alias("taken"))

    taken = F.aggregate("turns", empty, take)["taken"]
    return queues.select("site", "prefix", F.posexplode(taken).alias("place", "x")).select("site", "prefix", "x.url", "x.parent", "place")


def semantic_crawl(
    seeds: DataFrame, links: DataFrame, pages: DataFrame, rules: DataFrame, max_depth: int = 2, max_pages: int = 15, per_page: int = 4, prefix_lock: bool = True, agent: str = "*"
) -> DataFrame:
    """(site, position, url, depth, parent, status, starts_ms): what crawls of all sites visit, in order.

    seeds: site, url; links: url, link, ord and, if they are ranked, score; pages: url; rules as of
    ``web.robots_rules``. Every site has a queue of its own. A page that is there ("success")
    counts towards ``max_pages`` and adds its ``per_page`` best links that the site has not queued
    yet: by score, then by place. Pages that robots forbid ("skipped") or that are missing
    ("failed") take their turn and add nothing. With ``prefix_lock`` links stay below the path of
    the first seed. ``starts_ms`` spaces visits by the robots' delay: half a second if none is named, three
    seconds at most.

    All sites advance by one depth a round: links meet the pages of the round by address, and a
    site's choices are a fold over its pages of this round. Repeated links of a page count once,
    by their best score and first place. Rows without address or site take no part. Without seeds the result
    is empty.
    """
    scored = links.where("url IS NOT NULL AND link IS NOT NULL").select("url", "link", F.coalesce("ord", F.lit(0)).cast("long").alias("ord"), (F.coalesce("score", F.lit(0.0)) if "score" in links.columns else F.lit(0.0)).cast("double").alias("score"))
    scored = scored.groupBy("url", "link").agg(F.min("ord").alias("ord"), F.max("score").alias("score"))
    start = seeds.where("site IS NOT NULL AND url IS NOT NULL").select("site", "url").distinct()
    by_site = Window.partitionBy("site").orderBy("url")
    prefix = F.regexp_replace(web.path(F.first("url").over(by_site)), "/$", "") if prefix_lock else F.lit("")
    level = start.select("site", prefix.alias("prefix"), "url", F.lit(None).cast("string").alias("parent"), (F.row_number().over(by_site) - 1).alias("place"))
    visits: DataFrame | None = None
    queued: DataFrame | None = None
    for depth in range(max_depth + 1):
        level = durable(level.withColumn("depth", F.lit(depth)))
        queued = level.select("site", "url") if queued is None else queued.unionAll(level.select("site", "url"))
        now = durable(_visited(level, visits, pages, rules, agent, max_pages))
        visits = now if visits is None else visits.unionAll(now)
        if depth == max_depth or now.isEmpty():
            break
        level = _chosen(now.where((F.col("status") == "success") & (F.col("n_pages") < max_pages)), queued, scored, per_page)
    position = F.row_number().over(Window.partitionBy("site").orderBy("depth", "place")).cast("long")
    mine = rules.where((F.col("verb") == "crawl-delay") & F.col("agent").isin("*", agent.lower()))
    seconds = mine.groupBy("host").agg(F.min_by(F.col("value").try_cast("double"), F.struct(F.col("agent") == "*", F.col("ord"))).alias("delay"))
    every = visits.withColumn("position", position).withColumn("host", web.host(F.col("url"))).join(seconds, "host", "left")
    wait = F.least(F.lit(3000.0), 1000 * F.coalesce(F.nullif("delay", F.lit(0.0)), F.lit(0.5)))
    return every.select("site", "position", "url", "depth", "parent", "status", ((F.col("position") - 1) * wait).cast("long").alias("starts_ms"))


def knowledge_sections(visits: DataFrame, contents: DataFrame) -> DataFrame:
    """(site, section, url, depth, title, anchor, toc, body, words): the crawled pages as sections of a site's document.

    contents: url, title, markdown, words, reading_minutes, one row an address. A leading heading that repeats the
    title goes.
    """
    pages = visits.where("status = 'success'").withColumn("section", F.row_number().over(Window.partitionBy("site").orderBy("position")).cast("long"))
    full = pages.join(contents.select("url", "title", "markdown", "words", "reading_minutes"), "url")
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^\w\s-]", ""), r"\s+", "-")
    anchor = F.concat(F.lit("section-"), "section", F.lit("-"), slug)
    toc = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- ["), "title", F.lit("](#"), anchor, F.lit(") *(Depth "), "depth", F.lit(", ~"), "reading_minutes", F.lit(" min)*"))
    heading = F.concat(F.lit("# "), "title")
    rest = F.regexp_replace(F.substr("markdown", F.length(heading) + 1), r"^\s+|\s+$", "")
    text = F.when(F.startswith("markdown", heading), rest).otherwise(F.col("markdown"))
    fields = F.concat(F.lit('okf_section_id: "sec-'), "section", F.lit('"\nsource_url: "'), "url", F.lit('"\ndepth: '), "depth", F.lit("\nword_count: "), "words", F.lit("\nest_read_time_min: "), "reading_minutes")
    body = F.concat(F.lit('<a id="'), anchor, F.lit('"></a>\n\n## '), "section", F.lit(". "), "title", F.lit("\n\n```yaml\n"), fields, F.lit("\n```\n\n"), text, F.lit("\n\n[⬆ Return to Table of Contents](#table-of-contents)\n\n---\n\n"))
    return full.select("site", "section", "url", "depth", "title", anchor.alias("anchor"), toc.alias("toc"), body.alias("body"), "words")


def knowledge_base(sections: DataFrame, date: str, focus: str = "") -> DataFrame:
    """(site, pages, words, text): a site's sections as one document under its table of contents; a site's budget bounds it."""
    rows = F.struct("section", "url", "toc", "body", "words")
    all_ = sections.groupBy("site").agg(F.array_sort(F.collect_list(rows)).alias("x"), F.count("*").alias("pages"), F.sum("words").cast("long").alias("words"))
    seed = F.col("x")[0]["url"]
    aim = f"> 🎯 **Semantic Focus:** *{focus}*\n\n" if focus else ""
    join = lambda f, by: F.array_join(F.transform("x", lambda s: s[f]), by)
    head = F.concat(
        F.lit("# Open Knowledge Framework (OKF) Knowledge Base\n\n**Source Domain:** `"), web.host(seed), F.lit("`  \n**Seed URL:** ["), seed, F.lit("]("), seed, F.lit(f")  \n**Crawled Date:** {date}  \n**Total Sections:** "),
        "pages", F.lit(" pages • **Total Words:** "), "words", F.lit(f" words  \n\n{aim}## Table of Contents\n\n"),
    )
    return all_.select("site", "pages", "words", F.concat(head, join("toc", "\n"), F.lit("\n\n---\n\n"), join("body", "")).alias("text"))
