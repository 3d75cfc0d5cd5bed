"""Registered queries of the web operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import frontier, reader, web
from marlstone.session import table


def url_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", web.host(u).alias("host"), web.path(u).alias("path"), web.is_page_url(u).alias("is_page"), web.without_tracking(F.regexp_replace(u, "#.*$", "")).alias("clean"))


def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.path_tree(table(spark, sf_dir, "pages"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.page_links(table(spark, sf_dir, "pages")).groupBy("url").agg(F.count("*").alias("n_links"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.articles(table(spark, sf_dir, "pages")).select("page_id", "title", "words", "reading_minutes", "markdown")


#: Pages with clutter put before the article, by page number; Spark and DuckDB share the statement.
CLUTTERED = """
SELECT page_id, url, replace(html, '<article>',
  CASE WHEN page_id % 2 = 0 THEN '<div id="Cookie-Notice"><p class="consent">c</p></div>' ELSE '' END ||
  CASE WHEN page_id % 3 = 0 THEN '<div class="top modal">m</div><div class="modal article-x">kept</div>' ELSE '' END ||
  CASE WHEN page_id % 5 = 0 THEN '<aside class="pullquote">q</aside><aside>z</aside>' ELSE '' END ||
  CASE WHEN page_id % 7 = 0 THEN '<div class="Big-Sponsor"><span data-ad="1">s</span></div><i data-ad></i>' ELSE '' END ||
  CASE WHEN page_id % 11 = 0 THEN '<img src="/spacer.gif"><img src="a.png" width="1"><img src="b.png" width="10">' ELSE '' END || '<article>') AS html
FROM pages
"""


def reader_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.reader_articles(table(spark, sf_dir, "pages")).drop("html")


def reader_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    pages.createOrReplaceTempView("pages")
    found = reader.reader_articles(spark.sql(CLUTTERED))
    # Short pages are read with rules given up; what is left of them is no matter of counting tags.
    long = pages.select("page_id", (F.length(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)) > 1000).alias("long"))
    counts = found.join(long, "page_id")
    if_long = lambda c: F.when(F.col("long"), c.cast("long"))
    return counts.select("page_id", "site_name", "pruned", "ads_removed", "is_article", if_long(F.size(F.split("html", "<p[ >]")) - 1).alias("paragraphs"), if_long(F.regexp_count("html", F.lit("<img "))).alias("images"))


def merged_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.merged_digest(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.concat(F.lit("Turn "), F.col("turn"), F.lit(" by "), F.col("role")), F.col("text"))


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "supplier").select(F.concat(F.lit("https://s"), F.col("s_nationkey"), F.lit(".example.com/")).alias("url"), F.concat(F.lit("https://s"), (F.col("s_nationkey") * 2 + F.col("s_suppkey") % 3) % 25, F.lit(".example.com/")).alias("link")).distinct()
    seeds = spark.createDataFrame([("https://s1.example.com/",)], "url string")
    return web.crawl(links, seeds, 2)


#: A site for each nation, a page for each of its customers: some below /blog, some forbidden, some missing; each
#: names seven others, which carry a score. Spark and DuckDB share the statements.
_SITE_ROWS = """
SELECT c_nationkey AS site, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer
"""


def _address(i: str) -> str:
    return f"""'https://n' || CAST(site AS STRING) || '.example.com' || CASE WHEN {i} = 0 THEN '/docs' WHEN {i} % 9 = 8 THEN '/blog/p' || CAST({i} AS STRING) WHEN {i} % 7 = 3 THEN '/docs/private/p' || CAST({i} AS STRING) ELSE '/docs/p' || CAST({i} AS STRING) END"""


SITE_PAGES = f"""SELECT site, i, c_name AS title, {_address('i')} AS url, '# ' || c_name || chr(10) || chr(10) || 'Trades in ' || c_mktsegment || '.' AS markdown FROM ({_SITE_ROWS}) s WHERE i % 11 <> 5"""
SITE_LINKS = f"""
SELECT site, {_address('i')} AS url, {_address('((i * 3 + k * k + 1) % n)')} AS link, k AS ord, CAST((i * 5 + k * 3) % 4 AS DOUBLE) AS score
FROM ({_SITE_ROWS}) s CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) v(k)
"""


def _crawled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    pages, links = spark.sql(SITE_PAGES), spark.sql(SITE_LINKS)
    delay = F.when(F.col("site") % 2 == 1, F.lit("\nCrawl-delay: 2")).otherwise("")
    files = pages.select("site").distinct().select(F.concat(F.lit("n"), "site", F.lit(".example.com")).alias("host"), F.concat(F.lit("User-agent: *\nDisallow: /docs/private"), delay).alias("text"))
    seeds = spark.sql(f"SELECT DISTINCT site, {_address('0')} AS url FROM ({_SITE_ROWS}) s")
    return frontier.semantic_crawl(seeds, links.drop("site"), pages, web.robots_rules(files), max_depth=4, max_pages=40), pages


def semantic_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir)[0]


def knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits, pages = _crawled(spark, sf_dir)
    contents = pages.select("url", "title", "markdown", F.lit(5).alias("words"), F.lit(1).alias("reading_minutes"))
    return frontier.knowledge_base(frontier.knowledge_sections(visits, contents), "Sat, 28 Nov 2026", "trade")


#: The queue of every site, one address a step.
_WALK = f"""
        p AS ({SITE_PAGES}), l AS (SELECT site, url, list(link ORDER BY score DESC, ord, link) AS links FROM (SELECT site, url, link, min(ord) AS ord, max(score) AS score FROM ({SITE_LINKS}) WHERE contains(link, '.com/docs') GROUP BY ALL) GROUP BY ALL),
        r AS (
          SELECT DISTINCT site, [{_address('0')}] AS queue, [0] AS depths, [CAST(NULL AS VARCHAR)] AS parents, 0 AS pos, 0 AS n, CAST(NULL AS VARCHAR) AS status FROM ({_SITE_ROWS})
          UNION ALL
          SELECT site, queue || new, depths || list_transform(new, lambda x: d + 1), parents || list_transform(new, lambda x: u), pos + 1, n + CASE WHEN state = 'success' THEN 1 ELSE 0 END, state FROM (
            SELECT *, CASE WHEN state = 'success' AND d < 4 AND n + 1 < 40 THEN list_filter(coalesce(links, []), lambda x: NOT list_contains(queue, x))[1:4] ELSE [] END AS new FROM (
              SELECT r.*, r.queue[r.pos + 1] AS u, r.depths[r.pos + 1] AS d, l.links, CASE WHEN contains(r.queue[r.pos + 1], '/docs/private') THEN 'skipped' WHEN p.url IS NULL THEN 'failed' ELSE 'success' END AS state
              FROM r LEFT JOIN l ON l.url = r.queue[r.pos + 1] LEFT JOIN p ON p.url = r.queue[r.pos + 1] WHERE r.pos < len(r.queue) AND r.n < 40))
        ),
        v AS (SELECT site, CAST(pos AS BIGINT) AS position, queue[pos] AS url, CAST(depths[pos] AS INTEGER) AS depth, parents[pos] AS parent, status, CAST((pos - 1) * CASE WHEN site % 2 = 1 THEN 2000 ELSE 500 END AS BIGINT) AS starts_ms FROM r WHERE pos > 0)"""
_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1))"
_PATH = "CASE WHEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
_ENDINGS = "|".join(web.NOT_PAGES)
ORACLES = {
    "url_checks": rf"""
        SELECT page_id, {_HOST} AS host, {_PATH} AS path, regexp_matches(url, '^(?i)https?://[^/?#\s]+') AND NOT regexp_matches(lower({_PATH}), '\.(?:{_ENDINGS})(?:/|$)') AS is_page,
          regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(?:(?:utm_source|utm_medium|utm_campaign|ref)=[^&#]*(?:&|$))+', '\1', 'g'), '[?&]$', '') AS clean FROM pages""",
    "path_tree": rf"""
        WITH s AS (SELECT list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS g FROM pages), e AS (SELECT g, unnest(range(1, len(g) + 1)) AS depth FROM s WHERE len(g) > 0)
        SELECT '/' || array_to_string(g[1:depth], '/') AS path, CAST(depth AS INTEGER) AS depth, count(*) AS n_urls FROM e GROUP BY 1, 2""",
    # Clutter by the rules, paragraphs of the article and the advertisement before it (a box of text alone is a
    # paragraph, kept if it is a sentence of under 80 characters or longer than that); images before the article are left out.
    "reader_counts": r"""
        WITH p AS (
          SELECT page_id, url, html, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body,
            trim(regexp_replace(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1), '\s+', ' ', 'g')) AS ad FROM pages
        )
        SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^www\.', '') AS site_name,
          len(regexp_extract_all(html, '<(script|style|nav|footer)[ >]')) + CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END
            + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN page_id % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN page_id % 11 = 0 THEN 2 ELSE 0 END AS pruned,
          CASE WHEN page_id % 7 = 0 THEN 2 ELSE 0 END AS ads_removed, true AS is_article,
          CASE WHEN length(body) > 1000 THEN len(regexp_extract_all(body, '<p>')) + CASE WHEN length(ad) > 80 OR (length(ad) BETWEEN 1 AND 79 AND regexp_matches(ad, '\.( |$)')) THEN 1 ELSE 0 END END AS paragraphs,
          CASE WHEN length(body) > 1000 THEN 0 END AS images
        FROM p""",
    "merged_digest": """
        WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, 'Turn ' || turn || ' by ' || role, text) AS i FROM conversations)
        SELECT conv_id, count(*) AS n_items, '# Table of Contents' || chr(10) || string_agg(i || '. Turn ' || turn || ' by ' || role, chr(10) ORDER BY i) || chr(10) || chr(10) ||
          string_agg('## Turn ' || turn || ' by ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS digest FROM n GROUP BY conv_id""",
    "semantic_crawl": f"WITH RECURSIVE {_WALK} SELECT * FROM v",
    "knowledge_base": f"""
        WITH RECURSIVE {_WALK},
        s AS (SELECT v.site, v.url, depth, title, row_number() OVER (PARTITION BY v.site ORDER BY position) AS k, markdown FROM v JOIN p ON p.url = v.url WHERE status = 'success'),
        a AS (SELECT *, 'section-' || k || '-' || replace(replace(lower(title), '#', ''), ' ', '-') AS anchor FROM s)
        SELECT site, count(*) AS pages, 5 * count(*) AS words, '# Open Knowledge Framework (OKF) Knowledge Base' || chr(10) || chr(10) || '**Source Domain:** `n' || site || '.example.com`  ' || chr(10) || '**Seed URL:** [https://n' || site || '.example.com/docs](https://n' || site || '.example.com/docs)  ' || chr(10) ||
          '**Crawled Date:** Sat, 28 Nov 2026  ' || chr(10) || '**Total Sections:** ' || count(*) || ' pages • **Total Words:** ' || 5 * count(*) || ' words  ' || chr(10) || chr(10) || '> 🎯 **Semantic Focus:** *trade*' || chr(10) || chr(10) || '## Table of Contents' || chr(10) || chr(10) ||
          string_agg(repeat('  ', depth) || '- [' || title || '](#' || anchor || ') *(Depth ' || depth || ', ~1 min)*', chr(10) ORDER BY k) || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
          string_agg('<a id="' || anchor || '"></a>' || chr(10) || chr(10) || '## ' || k || '. ' || title || chr(10) || chr(10) || '```yaml' || chr(10) || 'okf_section_id: "sec-' || k || '"' || chr(10) || 'source_url: "' || url || '"' || chr(10) || 'depth: ' || depth || chr(10) || 'word_count: 5' || chr(10) || 'est_read_time_min: 1' || chr(10) || '```' || chr(10) || chr(10) ||
            split_part(markdown, chr(10) || chr(10), 2) || chr(10) || chr(10) || '[⬆ Return to Table of Contents](#table-of-contents)' || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY k) AS text
        FROM a GROUP BY site""",
    "crawl": """
        WITH l AS (SELECT DISTINCT s_nationkey AS a, (s_nationkey * 2 + s_suppkey % 3) % 25 AS b FROM supplier), h1 AS (SELECT DISTINCT b AS k FROM l WHERE a = 1 AND b <> 1), h2 AS (SELECT DISTINCT b AS k FROM l WHERE a IN (SELECT k FROM h1) AND b <> 1 AND b NOT IN (SELECT k FROM h1))
        SELECT 'https://s' || k || '.example.com/' AS url, d AS depth FROM (SELECT 1 AS k, 0 AS d UNION ALL SELECT k, 1 FROM h1 UNION ALL SELECT k, 2 FROM h2)""",
}
QUERIES = {f.__name__: f for f in (url_checks, path_tree, page_links, articles, reader_articles, reader_counts, merged_digest, crawl, semantic_crawl, knowledge_base)}
