"""Semantic crawls against a walk with one queue for each site."""

import random

from pyspark.sql import functions as F

from marlstone.operators import frontier, web

RULES = "host string, agent string, verb string, value string, ord int"


def _walk(seed, links, there, depth, pages, per_page):
    """One queue, one address at a time."""
    queue, out, n, at = [(seed, 0, None)], [], 0, 0
    while at < len(queue) and n < pages:
        url, d, parent = queue[at]
        at += 1
        state = "skipped" if "/no" in url else "success" if url in there else "failed"
        out.append((at, url, d, parent, state))
        if state != "success":
            continue
        n += 1
        if d < depth and n < pages:
            known = {q[0] for q in queue}
            queue += [(u, d + 1, url) for u in [u for u in links.get(url, []) if u not in known][:per_page]]
    return out


def test_equals_a_walk(spark):
    rng = random.Random(7)
    rows, seeds, there, want = [], [], set(), []
    for site in range(6):
        n = rng.choice([1, 3, 30, 60])
        urls = [f"https://h{site}.org/{rng.choice(['a', 'a', 'no'])}/{i}" for i in range(n)]
        urls[0] = f"https://h{site}.org/a/0"
        there |= {u for u in urls if rng.random() < 0.85}
        best: dict = {}
        for u in urls:
            for k in range(rng.randint(0, 12)):
                # Many equal scores, repeated links, links to itself.
                link, score = rng.choice(urls), float(rng.randint(0, 2))
                rows.append((u, link, k, score))
                s, o = best.setdefault(u, {}).get(link, (score, k))
                best[u][link] = (max(s, score), min(o, k))
        ordered = {u: sorted(m, key=lambda x: (-m[x][0], m[x][1], x)) for u, m in best.items()}
        seeds.append((site, urls[0]))
        want += [(site, *r) for r in _walk(urls[0], ordered, there, 4, 25, 3)]
    rows += [(None, "https://h1.org/a/1", 0, 1.0), ("https://h1.org/a/0", None, 0, 9.0)]
    seeds += [(None, "https://h1.org/a/1"), (9, None)]
    links = spark.createDataFrame(rows, "url string, link string, ord int, score double").repartition(5)
    pages = spark.createDataFrame([(u,) for u in there for _ in range(2)], "url string")
    rules = spark.createDataFrame([(f"h{i}.org", "*", "disallow", "/no", 1) for i in range(6)] + [("h0.org", "*", "crawl-delay", "9", 2)], RULES)
    got = frontier.semantic_crawl(spark.createDataFrame(seeds, "site long, url string"), links, pages, rules, 4, 25, 3, prefix_lock=False).collect()
    assert sorted((r.site, r.position, r.url, r.depth, r.parent, r.status) for r in got) == sorted(want)
    assert all(r.starts_ms == (r.position - 1) * (3000 if r.site == 0 else 500) for r in got)


def test_crawl_of_nothing(spark):
    none = spark.createDataFrame([], "site long, url string")
    links = spark.createDataFrame([], "url string, link string, ord int")
    rules = spark.createDataFrame([], RULES)
    assert frontier.semantic_crawl(none, links, none.select("url"), rules).collect() == []
    one = spark.createDataFrame([(1, "https://x.org/a/")], "site long, url string")
    assert [(r.status, r.depth) for r in frontier.semantic_crawl(one, links, none.select("url"), rules).collect()] == [("failed", 0)]


def test_prefix_and_sections(spark):
    seeds = spark.createDataFrame([(1, "https://x.org/docs/")], "site long, url string")
    html = '<a href="/docs/b">b</a><a href="/blog/c">c</a><a href="/docs/a#x">a</a><a href="/docs/a?ref=1">a</a><a href="mailto:x@y">m</a><a href="/docs/login">l</a><a href="/docs/z.pdf">z</a>'
    pages = spark.createDataFrame([("https://x.org/docs/", html), ("https://x.org/docs/a", ""), ("https://x.org/docs/b", None)], "url string, html string")
    links = frontier.candidate_links(pages)
    assert sorted((r.link, r.ord) for r in links.collect()) == [("https://x.org/blog/c", 1), ("https://x.org/docs/a", 2), ("https://x.org/docs/b", 0)]
    assert {(r.url, r.link) for r in links.collect()} == {(r.url, r.link) for r in web.page_links(pages).collect()}
    scored = links.withColumn("score", frontier.focus_score(F.col("link"), F.col("url"), "A"))
    visits = frontier.semantic_crawl(seeds, scored, pages, spark.createDataFrame([], RULES))
    assert [r.url[13:] for r in visits.orderBy("position").collect()] == ["/docs/", "/docs/a", "/docs/b"]
    contents = pages.select("url", F.lit("The (a) Page").alias("title"), F.lit("# The (a) Page\n\nText\n").alias("markdown"), F.lit(2).alias("words"), F.lit(1).alias("reading_minutes"))
    sections = frontier.knowledge_sections(visits, contents)
    second = sections.where("section = 2").first()
    assert second.anchor == "section-2-the-a-page" and second.toc == "  - [The (a) Page](#section-2-the-a-page) *(Depth 1, ~1 min)*"
    assert "```\n\nText\n\n[" in second.body
    whole = frontier.knowledge_base(sections, "today").first()
    assert whole.pages == 3 and whole.words == 6 and whole.text.count("<a id=") == 3 and "Semantic Focus" not in whole.text


def test_focus_score(spark):
    row = spark.sql("SELECT 'https://x.org/docs/guide/a' u, 'https://x.org/docs/guide/setup' v, 'https://x.org/' w")
    got = row.select(frontier.focus_score(F.col("v"), F.col("u"), "setup").alias("a"), frontier.focus_score(F.col("w"), F.col("u")).alias("b")).first()
    assert (got.a, got.b) == (4.0, 0.0)
