"""Reader mode: selectors, pruning, the article's choice, Markdown rules, and pages of the tables."""

import html as entities
import re

import duckdb
import pytest

from marlstone.operators import reader

SF = "/root/testdata/sf0.001"
GUIDE = """<html><head><title>Guide to widgets and gears | Site</title><meta name="author" content="A B"></head><body><div class="Header">x</div><div id="main-content"><h1>Guide to widgets and gears</h1>
<p>First paragraph, with <b>bold</b>, <em>it</em>, <code>a_b</code> and <a href="/x(1)">a link</a>, long enough to be scored by the rules of the reader, is it not.</p>
<p>Second para_graph<br>next line, with 1*2 and [x], and a formula <span class="katex"><annotation encoding="application/x-tex">x^2</annotation>shown</span>, again long enough for points.</p>
<ul><li>one<ul><li>in</li></ul></li><li>two <del>old</del></li></ul><ol start="3"><li>c</li><li>d</li></ol>
<pre class="language-Python"><code>def f():
    return 1
</code></pre>
<table><tr><th align="right">a</th><th>b</th></tr><tr><td>1|2</td><td>x<br>y</td></tr></table>
<div class="callout"><p>Note one.</p><p>Note two, with a comma, and another, and enough of text to stay there.</p></div>
<blockquote><p>Quoted words.</p></blockquote><img src="p.png" alt="pic"><img src="/spacer.gif"></div></body></html>"""
GUIDE_MARKDOWN = """First paragraph, with **bold**, *it*, `a_b` and [a link](https://docs.example.com/x\\(1\\)), long enough to be scored by the rules of the reader, is it not.

Second para\\_graph  
next line, with 1\\*2 and \\[x\\], and a formula $x^2$, again long enough for points.

-   one
    -   in
-   two ~old~

3.  c
4.  d

```python
def f():
    return 1
```

| a | b |
| --: | --- |
| 1\\|2 | x  <br>y |

> Note one.
> 
> Note two, with a comma, and another, and enough of text to stay there.

> Quoted words.

![pic](https://docs.example.com/a/p.png)"""


def test_golden_article():
    got = reader.read_article(GUIDE, "https://docs.example.com/a/b")
    assert got["markdown"] == GUIDE_MARKDOWN
    assert (got["title"], got["byline"], got["site_name"], got["pruned"], got["ads_removed"], got["is_article"]) == ("Guide to widgets and gears", "A B", "docs.example.com", 2, 0, True)
    assert "*[Image: pic]*" in reader.read_article(GUIDE, None, without_images=True)["markdown"]
    assert reader.read_article(GUIDE, "https://other.example.com/")["pruned"] == 1  # .Header is clutter of documentation sites only


@pytest.mark.parametrize(
    "selector,want",
    [
        ("div", "a d"), (".x", "a b"), ("#B", "b"), ("[data-ad]", "c"), ("[class*='X' i]", "a b d"), ("[class*='X']", "d"), ("[class^='y']", "b"), ("div:not(.x)", "d"),
        ("[class*='x' i]:not([class*='big'])", "a b"), ("button:not([role='tab'])", "f"), (".x .inner", "e"), ("span, .x", "a b c e"), ("[id*='']", ""), ("div.x[title='t']", "a"),
    ],
)
def test_selectors(selector, want):
    page = reader.Page(reader.parse('<div class="x" title="t" n="a"><p class="y x" id="B" n="b"><span data-ad n="c">t</span></p><span class="inner" n="e"></span></div><div class="bigX" n="d"></div><button n="f"></button><button role="tab" n="g"></button>'))
    assert sorted(n.attrs["n"] for n in page.select(selector)) == want.split()


def test_unknown_selector():
    with pytest.raises(ValueError):
        reader.Page(reader.parse("<p>")).select("p >> a")


def test_pruning_counts():
    html = '<nav><form><input></form></nav><header class="article-header">k</header><header>x</header><div class="ad-slot"><div class="ad-slot">y</div></div><aside class="pullquote">q</aside><i aria-hidden="true" class="math">m</i><i aria-hidden="true">h</i><img width="0"><img src="t/beacon.png"><img src="ok.png">'
    page = reader.Page(reader.parse(html))
    # nav with its form and input is one; nested boxes of one selector are two; headers and slots count as advertising.
    assert reader.clean(page, None) == (7, 3)
    assert re.sub(r"\s", "", page.root.text()) == "kqm"


def test_sites():
    wiki = '<body><div id="toc">t</div><p>Euler <span class="mwe-math-element" alt="e^{i}">m</span> and <math><annotation encoding="application/x-tex">a_1</annotation></math> in <a href="/wiki/X">x</a> <a href="//cdn/y">y</a><span class="mw-editsection">edit</span></p><div class="reflist"><a class="mw-cite-backlink">^</a>r</div><a class="mw-cite-backlink">kept</a></body>'
    page = reader.Page(reader.parse(wiki))
    assert reader.clean(page, "https://de.WIKIPEDIA.org/wiki/E") == (3, 0)
    text = reader.to_markdown(page.root)
    assert "$e^{i}$" in text and "$$\na_1\n$$" in text and "https://en.wikipedia.org/wiki/X" in text and "(//cdn/y)" in text and "kept" in text and "edit" not in text
    medium = '<p data-test-id="post-sidebar">a</p><p class="speechify-ignore">b</p><p>c</p>'
    page = reader.Page(reader.parse(medium))
    assert reader.clean(page, "https://x.medium.com/p") == (2, 0) and reader.clean(reader.Page(reader.parse(medium)), "https://example.com") == (0, 0)


@pytest.mark.parametrize(
    "html,want",
    [
        ("<p>a<p>b", "a\n\nb"), ("<ul><li>a<li>b</ul>", "-   a\n-   b"), ("x <b> y </b>z", "x **y** z"), ("<hr>", "---"), ("1. a", "1\\. a"), ("# a", "\\# a"), ("<p>- a</p>", "\\- a"), ("<a href=''>x</a><a href='/u' title='t'>y</a>", 'x[y](/u "t")'), ("<h3>T</h3>u", "### T\n\nu"),
        ("<code>a`b</code>", "``a`b``"), ("<ul><li><input type=checkbox checked> done</li></ul>", "-   [x]  done"), ("<table><tr><td>a</table>", "| a |\n| --- |"), ("<div class='highlight'><code class='lang-JS'> x </code></div>", "```js\nx\n```"), ("a &amp; b", "a & b"), ("", ""), ("<b></b>", ""),
        ("<ul><li>a<p>b</p></li></ul>", "-   a\n    \n    b"), ("  a \n b  ", "a b"), ("<span data-math='x+y'>z</span>", "$x+y$"),
    ],
)
def test_markdown_rules(html, want):
    assert reader.to_markdown(reader.parse(html)) == want


def test_links_and_boxes_do_not_win():
    links = "<div>" + "".join(f'<p><a href="/{i}">a link text that is long enough, number {i}</a></p>' for i in range(30)) + "</div>"
    prose = "<div><p>" + "Words of the article, in sentences, with commas. " * 6 + "</p><p>" + "More words, and more of them, to be read. " * 5 + "</p></div>"
    got = reader.read_article(f'<body>{links}{prose}<div class="sidebar"><p>{"Aside words, of no use, in a box. " * 4}</p></div></body>', "https://e.com/")
    assert "Words of the article" in got["markdown"] and "More words" in got["markdown"] and "link text" not in got["markdown"] and "Aside words" not in got["markdown"]


def test_nothing_and_broken():
    for html in (None, "", "  \n"):
        got = reader.read_article(html, title="T")
        assert got["title"] == "T" and got["markdown"] == "" and not got["is_article"] and got["reading_minutes"] == 0
    assert reader.read_article(None)["title"] == "Untitled Document"
    assert reader.read_article("<p>open <b>x", "http://www.e.com:1/")["markdown"] == "open **x**"
    assert reader.read_article("<div" * 2000 + ">" * 2000)["title"] == "Web Document"
    assert "deep" in reader.read_article("<div>" * 300 + "deep" + "</div>" * 300)["markdown"]


def plain_page(html):
    """The Markdown of the tables' pages, by regular expressions for their one layout."""
    body = re.search(r"(?s)<article>(.*)</article>", html)[1]
    ad = re.sub(r"\s+", " ", entities.unescape(re.search(r'(?s)<div class="ad">(.*?)</div>', html)[1])).strip()
    parts = [ad] if len(ad) > 80 or (0 < len(ad) < 80 and re.search(r"\.( |$)", ad)) else []
    marks = lambda s: re.sub(r"([\\*`\[\]_])", r"\\\1", re.sub(r"^(-|>|=+|#{1,6} |\d+(?=\. ))", lambda m: m[1] + "\\" if m[1].isdigit() else "\\" + m[1], re.sub(r"\s+", " ", entities.unescape(s)).strip()))
    out = [marks(p) for p in parts]
    for p in re.findall(r"(?s)<p>(.*?)(?=<p>|</p>|$)", re.sub(r"(?s)^.*?</h1>", "", body)):
        bold = re.fullmatch(r"(?s)<b>(.*)<br>\s*", p)
        out.append(f"**{marks(bold[1])}**" if bold else marks(p))
    return "\n\n".join(out)


def test_pages_of_the_tables(spark):
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet' ORDER BY page_id").fetchall()
    got = {r["page_id"]: r for r in reader.reader_articles(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows[:10]:
        assert re.sub(r"\*\* *\n", "**\n", got[page_id]["markdown"]) == plain_page(html)
