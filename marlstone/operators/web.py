"""Web pages: URL rules, links, robots and llms.txt files, site trees, crawling and reader mode."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import bound_batches, durable

# Endings of paths that are no web pages.
NOT_PAGES = """
pdf doc docx ppt pptx xls xlsx epub mobi rtf odt ods odp zip tar gz tgz bz2 xz 7z rar exe dmg pkg deb rpm iso apk jar bin
png jpg jpeg gif webp svg ico bmp tiff avif mp3 mp4 wav ogg webm mov avi mkv flac aac woff woff2 ttf eot otf sql db sqlite
""".split()
# Parts of addresses that a crawl leaves out, and parameters that only track.
SKIPPED_PARTS = ("/login", "/signin", "/signup", "/logout", "/auth", "/privacy", "/terms", "/cart", "/checkout")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "ref")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def path(url: Column) -> Column:
    p = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def is_page_url(url: Column) -> Column:
    """http or https, and no file ending that is not a page's."""
    endings = "|".join(NOT_PAGES)
    return url.rlike(r"^(?i)https?://[^/?#\s]+") & ~F.lower(path(url)).rlike(rf"\.(?:{endings})(?:/|$)")


def unsafe_reason(url: Column) -> Column:
    """Why an address must not be fetched; null if it may."""
    h = host(url)
    octets = [F.regexp_extract(h, r"^(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}$", i).try_cast("int") for i in (1, 2)]
    a, b = octets
    private = (a.isin(0, 10, 127)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
    return (
        F.when(~url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), "malformed")
        .when(~url.rlike(r"^(?i)https?://[^/?#\s]+"), "protocol")
        .when(h.isin("localhost", "127.0.0.1", "[::1]", "0.0.0.0") | h.endswith(".local") | h.endswith(".internal"), "local")
        .when(h == "169.254.169.254", "metadata")
        .when(F.coalesce(private, F.lit(False)), "private")
    )


def web_links(text: Column) -> Column:
    """The distinct page addresses of a Markdown text: of its links first, then the bare ones."""
    linked = F.regexp_extract_all(text, F.lit(r"(?i)\[[^\]]*\]\((https?://[^\s)]+)\)"), F.lit(1))
    bare = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(https?://[^\s<>\"'{}|\\^`]+)"), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:)!]+$", ""))
    return F.filter(F.array_distinct(F.concat(linked, bare)), is_page_url)


def resolved(href: Column, base: Column) -> Column:
    """An address relative to a page's, without its fragment."""
    clean = F.regexp_replace(href, r"#.*$", "")
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    folder = F.concat(root, F.regexp_replace(path(base), r"[^/]*$", ""))
    full = F.when(clean.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), clean).when(clean.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), clean)).when(clean.startswith("/"), F.concat(root, clean)).when(clean.startswith("?"), F.concat(root, path(base), clean)).otherwise(F.concat(folder, clean))
    dots = F.regexp_replace(full, r"/\./", "/")
    for _ in range(4):
        dots = F.regexp_replace(dots, r"(?<=[^/:])/(?!\.\./)[^/?#:]+/\.\./", "/")
    return dots


def without_tracking(url: Column) -> Column:
    u = F.regexp_replace(url, rf"([?&])(?:(?:{'|'.join(TRACKING)})=[^&#]*(?:&|$))+", "$1")
    return F.regexp_replace(u, r"[?&]$", "")


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html", same_host: bool = True) -> DataFrame:
    """Distinct (url, link) of the pages that a page's anchors lead to."""
    hrefs = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)<a\b[^>]*href=["']([^"']+)["'][^>]*>"""), F.lit(1))
    found = pages.select(F.col(url_col).alias("url"), F.explode(hrefs).alias("href")).withColumn("href", F.trim("href")).where(~F.col("href").rlike(r"^(?:#|javascript:|mailto:|tel:|$)"))
    full = found.select("url", without_tracking(resolved(F.col("href"), F.col("url"))).alias("link")).where(is_page_url(F.col("link")))
    if same_host:
        full = full.where(host(F.col("link")) == host(F.col("url")))
    low = F.lower("link")
    skipped = F.lit(False)
    for part in SKIPPED_PARTS:
        skipped = skipped | low.contains(part)
    return full.where(~skipped).distinct()


def path_tree(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """(path, depth, n_urls) of every folder and leaf of the addresses' paths."""
    segments = F.filter(F.split(path(F.col(url_col)), "/"), lambda s: s != "")
    cut = urls.select(segments.alias("segments")).where(F.size("segments") > 0)
    each = cut.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("segments")), lambda n: F.struct(F.concat(F.lit("/"), F.array_join(F.slice("segments", F.lit(1), n), "/")).alias("path"), n.alias("depth")))).alias("x"))
    return each.groupBy("x.path", "x.depth").agg(F.count("*").alias("n_urls"))


def site_map(sitemap: DataFrame, llms: DataFrame, prefix: str = "", endings: tuple[str, ...] = (), word: str = "") -> DataFrame:
    """Addresses of both lists, each once with its first source, through the filters."""
    both = sitemap.select("url", F.lit(1).alias("source")).unionAll(llms.select("url", F.lit(2).alias("source"))).groupBy("url").agg(F.min("source").alias("source"))
    kept = both.where(is_page_url(F.col("url")))
    if prefix:
        kept = kept.where(path(F.col("url")).contains(prefix))
    if endings:
        kept = kept.where(F.lower("url").rlike("|".join(re.escape("." + e.lstrip(".")) for e in endings)))
    if word:
        kept = kept.where(F.lower("url").contains(word.lower()))
    return kept.select("url", F.when(F.col("source") == 1, "sitemap").otherwise("llms").alias("source"))


def robots_rules(files: DataFrame, host_col: str = "host", text_col: str = "text") -> DataFrame:
    """(host, agent, verb, value, ord) of allow, disallow, crawl-delay and sitemap lines, under the agent before them."""
    each = files.select(F.col(host_col).alias("host"), F.posexplode(F.split(text_col, r"\r?\n")).alias("ord", "line")).withColumn("line", F.trim("line")).where(F.col("line").contains(":") & ~F.col("line").startswith("#"))
    split = each.select("host", "ord", F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))).alias("verb"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"))
    past = Window.partitionBy("host").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    under = split.withColumn("agent", F.last(F.when(F.col("verb") == "user-agent", F.lower("value")), ignorenulls=True).over(past))
    return under.where(F.col("verb").isin("allow", "disallow", "crawl-delay", "sitemap") & (F.col("value") != "")).select("host", "agent", "verb", "value", "ord")


def allowed_by_robots(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """Addresses with ``allowed``: the agent's own rules, else those for all; an allow that fits wins."""
    mine = rules.where(F.col("agent") == agent.lower()).select("host").distinct().withColumn("own", F.lit(True))
    chosen = rules.join(mine, "host", "left").where(F.col("agent") == F.when(F.col("own"), agent.lower()).otherwise("*"))
    lists = chosen.groupBy("host").agg(F.collect_list(F.when(F.col("verb") == "allow", F.col("value"))).alias("allow"), F.collect_list(F.when(F.col("verb") == "disallow", F.col("value"))).alias("deny"))
    p = path(F.col("url"))
    fits = lambda c: F.exists(c, lambda v: p.startswith(v))
    return urls.withColumn("host", host(F.col("url"))).join(lists, "host", "left").select("url", F.when(F.col("allow").isNull() | fits(F.col("allow")), True).otherwise(~fits(F.col("deny"))).alias("allowed"))


def llms_sections(files: DataFrame, host_col: str = "host", text_col: str = "text") -> DataFrame:
    """(host, section, title, url, note) of the links of an llms.txt file, under its headings."""
    each = files.select(F.col(host_col).alias("host"), F.posexplode(F.split(text_col, r"\r?\n")).alias("ord", "line"))
    past = Window.partitionBy("host").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    under = each.withColumn("section", F.last(F.when(F.col("line").rlike(r"^##\s+"), F.trim(F.regexp_extract("line", r"^##\s+(.*)$", 1))), ignorenulls=True).over(past))
    link = r"^\s*[-*]\s*\[([^\]]+)\]\(([^)]+)\)(?::\s*(.*))?$"
    return under.where(F.col("line").rlike(link)).select("host", "section", *(F.regexp_extract("line", link, i).alias(n) for i, n in ((1, "title"), (2, "url"), (3, "note"))))


def sitemap_entries(files: DataFrame, host_col: str = "host", text_col: str = "text") -> DataFrame:
    """(host, url, lastmod, changefreq, priority, is_index) of sitemap files."""
    items = F.regexp_extract_all(F.col(text_col), F.lit(r"(?s)(<(?:url|sitemap)>.*?</(?:url|sitemap)>)"), F.lit(1))
    each = files.select(F.col(host_col).alias("host"), F.explode(items).alias("x"))
    inner = lambda tag: F.nullif(F.trim(F.regexp_extract("x", rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    return each.select("host", inner("loc").alias("url"), inner("lastmod").alias("lastmod"), inner("changefreq").alias("changefreq"), inner("priority").cast("double").alias("priority"), F.col("x").startswith("<sitemap>").alias("is_index")).where("url IS NOT NULL")


def crawl(links: DataFrame, seeds: DataFrame, depth: int = 2, most_pages: int | None = None, prefix: str = "") -> DataFrame:
    """(url, depth) of pages reached from seeds over (url, link) edges, breadth first.

    Each round joins the frontier with the links and drops what was visited.
    """
    found = durable(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    frontier = found
    for d in range(1, depth + 1):
        reached = links.join(frontier.select("url"), "url").select(F.col("link").alias("url")).distinct()
        if prefix:
            reached = reached.where(path(F.col("url")).startswith(prefix))
        frontier = durable(reached.join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        found = found.unionAll(frontier)
    return found if most_pages is None else found.orderBy("depth", "url").limit(most_pages)


# The plain conversion's own choice of elements to leave out, and of classes that mark them (reader.py has the fixed selectors).
_DROPPED = {"script", "style", "noscript", "template", "iframe", "svg", "nav", "footer", "header", "aside", "form", "button", "canvas"}
_NOISE = re.compile(r"(?:^|[\s_-])(?:nav|navbar|menu|sidebar|footer|header|cookie|banner|advert|ads|share|social|comments?|related|breadcrumbs?|popup|modal|newsletter)(?:$|[\s_-])")
_BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "figure", "dl", "dt", "dd"}
_VOID = {"br", "hr", "img", "meta", "link", "input", "source", "area", "base", "col", "embed", "track", "wbr"}


class Reader(HTMLParser):
    """Converts a page to Markdown, leaving out what is not its article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title = self.description = ""
        self.open: list[tuple[str, bool]] = []
        self.dropped = 0
        self.links: list[str] = []
        self.lists: list[list] = []
        self.row: list[str] | None = None
        self.n_rows = 0
        self.pre = False
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("name", "").lower() == "description":
            self.description = a.get("content", "")
        if tag in _VOID:
            if not self.dropped:
                self._void(tag, a)
            return
        noise = tag in _DROPPED or bool(_NOISE.search(f"{a.get('class', '')} {a.get('id', '')}".lower())) or a.get("role") in ("navigation", "banner", "contentinfo", "complementary") or a.get("aria-hidden") == "true"
        self.open.append((tag, noise))
        self.dropped += noise
        if tag == "title":
            self.in_title = True
        if self.dropped:
            return
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            language = re.search(r"lang(?:uage)?-(\w+)", a.get("class", ""))
            self.out.append(f"\n\n```{language[1] if language else ''}\n")
            self.pre = True
        elif tag == "a":
            self.links.append(a.get("href", ""))
            self.out.append("[")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            self._item()
        elif tag in ("td", "th"):
            self.out.append("\x00")
        elif tag == "tr":
            self.row = []
            self.out.append("\x01")
        elif tag == "table":
            self.n_rows = 0
            self.out.append("\n\n")
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag in _BLOCKS:
            self.out.append("\n\n")

    def _item(self) -> None:
        if self.lists:
            self.lists[-1][1] += 1
        mark = f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- "
        self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + mark)

    def _void(self, tag: str, a: dict) -> None:
        if tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "img" and a.get("src") and not (a.get("width") in ("0", "1") or a.get("height") in ("0", "1")):
            self.out.append(f"![{a.get('alt', '')}]({a['src']})")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in _VOID or tag not in (t for t, _ in self.open):
            return
        while self.open:
            t, noise = self.open.pop()
            silent = bool(self.dropped)
            self.dropped -= noise
            if not silent:
                self._close(t)
            if t == tag:
                break

    def _close(self, tag: str) -> None:
        if tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag == "a":
            href = self.links.pop() if self.links else ""
            self.out.append(f"]({href})")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n")
        elif tag == "tr":
            at = len(self.out) - 1 - self.out[::-1].index("\x01") if "\x01" in self.out else 0
            cells = [re.sub(r"\s+", " ", c).strip().replace("|", "\\|") for c in "".join(self.out[at + 1 :]).split("\x00")[1:]]
            del self.out[at:]
            self.out.append("\n| " + " | ".join(cells) + " |")
            if not self.n_rows:
                self.out.append("\n" + "|" + " --- |" * len(cells))
            self.n_rows += 1
        elif re.fullmatch("h[1-6]", tag) or tag in _BLOCKS:
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.dropped:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))

    def markdown(self) -> str:
        text = "".join(self.out).replace("\x00", " ").replace("\x01", "")
        text = re.sub(r"[ \t]+\n", "\n", text)
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"\[\s*\]\([^)]*\)", "", text)).strip()


def html_to_markdown(html: str) -> tuple[str, str, str]:
    """(title, description, Markdown) of a page; broken markup gives what was read."""
    reader = Reader()
    try:
        reader.feed(html or "")
        reader.close()
    except (AssertionError, ValueError):
        pass
    return unescape(reader.title).strip(), reader.description.strip(), reader.markdown()


def articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, title, description, markdown, words, reading_minutes) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [html_to_markdown(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([f[i] for f in found], pa.string()) for i in range(3))], ["page_id", "url", "title", "description", "markdown"])

    bound_batches(pages.sparkSession)
    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, title string, description string, markdown string")
    words = F.regexp_count("markdown", F.lit(r"\S+")).cast("long")
    return read.withColumn("words", words).withColumn("reading_minutes", F.greatest(F.lit(1), F.ceil(F.col("words") / 200)).cast("long"))


def merged_digest(items: DataFrame, group: str, order: str, title: Column, body: Column) -> DataFrame:
    """(group, n_items, digest): a table of contents and all bodies under their titles, in order."""
    each = items.select(F.col(group), F.struct(F.col(order).alias("o"), title.alias("t"), body.alias("b")).alias("x"))
    toc = F.array_join(F.transform("all", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"])), "\n")
    text = F.array_join(F.transform("all", lambda x: F.concat(F.lit("## "), x["t"], F.lit("\n\n"), x["b"])), "\n\n---\n\n")
    return each.groupBy(group).agg(F.array_sort(F.collect_list("x")).alias("all")).select(group, F.size("all").cast("long").alias("n_items"), F.concat(F.lit("# Table of Contents\n"), toc, F.lit("\n\n"), text).alias("digest"))
