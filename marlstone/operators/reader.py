"""Reader mode: a page's node tree, pruned by selectors, scored for its article and written as Markdown.

A page is parsed to a tree of elements. Clutter of known sites, then general clutter, then tracking
images are removed by selectors, in their order, and counted. Paragraphs then give their ancestors points
for text, commas and telling classes, less the share of their text that is links; the best candidate
and the siblings like it are the article. Where that keeps under 150 characters, rules are given up one
by one: unlikely names, class weights, the second look at lists and boxes. The article becomes Markdown
by rules for each element, with fenced code, formulas, callouts, tables, task lists and struck text.

Classes stay until the Markdown is written, as languages, formulas and callouts are told by them.

Pages are independent rows: everything runs in one narrow pass over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import bound_batches

# Selectors of clutter on any page, in the order in which they are applied and counted.
NOISE = """
script
style
noscript
template
canvas
dialog
applet
nav
header:not(.article-header):not(.entry-header):not(.post-header)
footer:not(.article-footer)
aside:not(.pullquote):not(.article-aside)
form
input
select
textarea
button:not([role='tab'])
[id*='cookie' i]
[class*='cookie' i]
[id*='consent' i]
[class*='consent' i]
[id*='gdpr' i]
[class*='gdpr' i]
[class*='newsletter' i]
[id*='newsletter' i]
[class*='subscribe' i]
[id*='subscribe' i]
[class*='paywall-banner' i]
[class*='modal' i]:not([class*='article'])
[class*='popup' i]
[class*='overlay' i]:not([class*='content'])
[class*='advert' i]
[id*='advert' i]
[class*='google-ad' i]
[id*='google-ad' i]
[class*='ad-container' i]
[class*='ad-wrapper' i]
[class*='ad-banner' i]
[class*='ad-slot' i]
[class*='dfp-ad' i]
[class*='taboola' i]
[id*='taboola' i]
[class*='outbrain' i]
[id*='outbrain' i]
[class*='sponsor' i]
[id*='sponsor' i]
[data-ad]
[data-ad-unit]
[class*='social-share' i]
[class*='share-buttons' i]
[class*='share-bar' i]
[id*='disqus' i]
[class*='disqus' i]
[id*='comments' i]:not([class*='post']):not([class*='article'])
[class*='comments' i]:not([class*='post']):not([class*='article'])
[class*='related-posts' i]
[class*='recommended-stories' i]
[class*='more-from' i]
[class*='trending' i]
[aria-hidden='true']:not([class*='math'])
.hidden:not([class*='math'])
.d-none:not([class*='math'])
""".strip().splitlines()
# Parts of addresses of known sites, and the selectors of clutter there.
SITES = (
    (("wikipedia.org", "wikimedia.org", "wiktionary.org"), ".mw-editsection|.navbox|.vertical-navbox|.sidebar|.ambox|.ombox|.tmbox|.cmbox|.fmbox|.toc|#toc|.vector-toc|.vector-page-toolbar|.vector-dropdown|.mw-jump-link|.noprint|.mw-empty-elt|.mw-file-description|.hatnote|.sister-project|.metadata|.portal|.mw-ui-button|#mw-navigation|#mw-related-navigation|#p-lang|.reflist .mw-cite-backlink".split("|")),
    (("medium.com", "substack.com"), "[data-test-id='post-sidebar']|[data-test-id='newsletter-banner']|.meteredContent|.speechify-ignore|[data-action='open-social-menu']".split("|")),
    (("github.com", "gitlab.com", "docs."), ".Header|.repohead|.file-navigation|.Box-header|.commit-tease|.pagehead-actions|.js-header-wrapper".split("|")),
)
# Which selectors count as advertising, which images track, how code names its language.
_ADVERTISING = re.compile(r"ad|banner|sponsor|taboola|outbrain|google", re.I)
_TRACKS = re.compile(r"1x1|spacer\.gif|pixel\.gif|tracking|beacon", re.I)
_LANGUAGE = re.compile(r"(?:language|lang|highlight-source)-([a-zA-Z0-9_-]+)", re.I)

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An opening tag ends an open element of the first names, unless one of the second stands between.
_ENDS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "thead": (("tbody", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)), "body": (("head",), ())}


class Node:
    """An element; its children are elements and strings."""

    __slots__ = ("attrs", "children", "classes", "parent", "points", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []
        self.classes = frozenset(self.attrs.get("class", "").split())
        self.points: float | None = None

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def _end(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """Close the outermost open element of ``tags`` that no ``stops`` shields."""
        node, found = self.at, None
        while node is not self.root and node.tag not in stops:
            found = node if node.tag in tags else found
            node = node.parent
        if found is not None:
            self.at = found.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ENDS_P:
            self._end(("p",), ("td", "th", "li", "blockquote", "div", "section", "article", "button", "object"))
        if tag in _ENDS:
            self._end(*_ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("path", "circle", "rect", "use", "g", "line", "mspace", "mi", "mo", "mn") and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    """The tree of a page; broken markup gives what was read."""
    builder = _Builder()
    try:
        builder.feed(html)
        builder.close()
    except (AssertionError, ValueError):
        pass
    return builder.root


# Selectors: a tag, classes, ids, attributes (present, =, *=, ^=, each with ``i``) and :not(), under ancestors.

_PART = re.compile(r"""\.([\w-]+)|\#([\w-]+)|\[([\w-]+)(?:([*^]?=)'([^']*)'(\s+i)?)?\]|:not\(((?:[^()]|\([^()]*\))*)\)""")


class _Compound:
    def __init__(self, text: str) -> None:
        self.tag = re.match(r"[\w-]*", text)[0]
        self.tests: list[tuple] = []
        self.key = None  # an attribute that every match has
        at = len(self.tag)
        while at < len(text):
            m = _PART.match(text, at)
            if m is None:
                raise ValueError(f"unknown selector: {text}")
            name, id_, attr, how, value, fold, inner = m.groups()
            if name:
                self.tests.append(("class", name))
            elif id_:
                self.tests.append(("id", id_))
            elif attr:
                self.tests.append((how or "has", attr, value.lower() if fold else value, bool(fold)))
            else:
                self.tests.append(("not", _Compound(inner)))
            self.key = self.key or ("class" if name else "id" if id_ else attr)
            at = m.end()

    def matches(self, node: Node) -> bool:
        if self.tag and node.tag != self.tag:
            return False
        for t in self.tests:
            if t[0] == "class":
                ok = t[1] in node.classes
            elif t[0] == "id":
                ok = node.attrs.get("id") == t[1]
            elif t[0] == "not":
                ok = not t[1].matches(node)
            elif t[1] not in node.attrs:
                ok = False
            else:
                value = node.attrs[t[1]].lower() if t[3] else node.attrs[t[1]]
                ok = t[0] == "has" or (value == t[2] if t[0] == "=" else bool(t[2]) and (t[2] in value if t[0] == "*=" else value.startswith(t[2])))
            if not ok:
                return False
        return True


@lru_cache(1024)
def _compiled(selector: str) -> list[list[_Compound]]:
    return [[_Compound(c) for c in re.findall(r"(?:[^\s\[(]|\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\))+", one)] for one in re.split(r",(?![^\[(]*[\])])", selector)]


class Page:
    """A tree with its elements by tag and attribute."""

    def __init__(self, root: Node) -> None:
        self.root = root
        self.by_tag: dict[str, list[Node]] = {}
        self.by_attr: dict[str, list[Node]] = {}
        self.nodes = list(root.walk())
        self.gone: set[int] = set()
        for n in self.nodes:
            self.by_tag.setdefault(n.tag, []).append(n)
            for a in n.attrs:
                self.by_attr.setdefault(a, []).append(n)

    def _present(self, node: Node) -> bool:
        return not self.gone or (id(node) not in self.gone and not any(id(a) in self.gone for a in node.ancestors()))

    def select(self, selector: str) -> list[Node]:
        """The elements still in the page that match, once each."""
        out = {}
        for chain in _compiled(selector):
            last = chain[-1]
            pool = self.by_tag.get(last.tag, []) if last.tag else self.by_attr.get(last.key, []) if last.key else self.nodes
            for n in pool:
                if id(n) not in out and last.matches(n) and self._present(n) and self._under(n, chain[:-1]):
                    out[id(n)] = n
        return list(out.values())

    @staticmethod
    def _under(node: Node, chain: list[_Compound]) -> bool:
        ancestors = node.ancestors()
        return all(any(c.matches(a) for a in ancestors) for c in reversed(chain))

    def drop(self, nodes: list[Node]) -> int:
        self.gone.update(id(n) for n in nodes)
        return len(nodes)

    def prune(self) -> None:
        """Take out what was dropped."""
        for n in self.nodes:
            if id(n) in self.gone:
                n.remove()


def _formulas(page: Page) -> None:
    for node in page.select(".mwe-math-element, math"):
        note = next((n for n in node.find("annotation") if n.attrs.get("encoding") == "application/x-tex"), None)
        tex = (node.attrs.get("alt") or (note.text() if note else "")).strip()
        if tex and node.parent is not None:
            block = node.tag == "math" or "mwe-math-fallback-image-display" in node.classes
            node.parent.children = [(f"\n\n$$\n{tex}\n$$\n\n" if block else f"${tex}$") if c is node else c for c in node.parent.children]
            page.gone.add(id(node))


def clean(page: Page, url: str | None) -> tuple[int, int]:
    """Remove clutter; how many elements matched, and how many of them by selectors of advertising."""
    pruned = ads = 0
    low = (url or "").lower()
    for i, (parts, selectors) in enumerate(SITES):
        if any(p in low for p in parts):
            pruned += sum(page.drop(page.select(s)) for s in selectors)
            if i == 0:
                _formulas(page)
                for link in page.select("a[href^='/']"):
                    if not link.attrs["href"].startswith("//"):
                        link.attrs["href"] = "https://en.wikipedia.org" + link.attrs["href"]
    for s in NOISE:
        n = page.drop(page.select(s))
        pruned += n
        ads += n * bool(_ADVERTISING.search(s))
    pruned += page.drop([n for n in page.select("img") if {n.attrs.get("width"), n.attrs.get("height")} & {"0", "1"} or _TRACKS.search(n.attrs.get("src", ""))])
    page.prune()
    return pruned, ads


# The article. Fixed values of the published scoring: names that make an element unlikely, likely, good or bad.
_UNLIKELY = re.compile(r"-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote", re.I)
_MAYBE = re.compile(r"and|article|body|column|content|main|mathjax|shadow", re.I)
_GOOD = re.compile(r"article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story", re.I)
_BAD = re.compile(r"-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget", re.I)
_ROLES = frozenset("menu menubar complementary navigation alert alertdialog dialog".split())
_BLOCKS = frozenset("blockquote dl div img ol p pre table ul".split())
_START = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
_LEAST = 150  # characters of an article
_BOX = 48  # characters of the box that the scoring puts around an article, which count


def _inner(node: Node) -> str:
    return re.sub(r"\s{2,}", " ", node.text().strip())


def _weight(node: Node, weigh: bool) -> int:
    names = [n for n in (node.attrs.get("class"), node.attrs.get("id")) if n] if weigh else []
    return sum(25 * bool(_GOOD.search(n)) - 25 * bool(_BAD.search(n)) for n in names)


def _link_density(node: Node) -> float:
    whole = len(_inner(node))
    return sum(len(_inner(a)) * (0.3 if a.attrs.get("href", "").startswith("#") else 1) for a in node.find("a")) / whole if whole else 0.0


def _copy(node: Node, parent: Node | None = None) -> Node:
    made = Node(node.tag, dict(node.attrs), parent)
    made.children = [c if isinstance(c, str) else _copy(c, made) for c in node.children]
    return made


def _same_title(node: Node, title: str) -> bool:
    words = lambda s: [w for w in re.split(r"\W+", s.lower()) if w]
    a, b = words(title), words(_inner(node))
    if not a or not b:
        return False
    rest = [w for w in b if w not in set(a)]
    return 1 - len(" ".join(rest)) / len(" ".join(b)) > 0.75


def _candidates(body: Node, title: str, unlikely: bool) -> list[Node]:
    """The elements to score; unlikely ones, empty boxes and the repeated title leave the tree."""
    out, titled = [], False
    stack = [body]
    while stack:
        node = stack.pop()
        if node is not body:
            names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
            style = node.attrs.get("style", "")
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style) or "hidden" in node.attrs:
                node.remove()
                continue
            if not titled and node.tag in ("h1", "h2") and _same_title(node, title):
                titled = True
                node.remove()
                continue
            if unlikely and node.tag not in ("body", "a") and ((_UNLIKELY.search(names) and not _MAYBE.search(names) and not any(a.tag in ("table", "code") for a in node.ancestors())) or node.attrs.get("role") in _ROLES):
                node.remove()
                continue
            if node.tag in ("div", "section", "header", "h1", "h2", "h3", "h4", "h5", "h6") and not node.text().strip() and not any(n.tag not in ("br", "hr") for n in node.walk()):
                node.remove()
                continue
        if node.tag == "div" and not any(n.tag in _BLOCKS for n in node.walk()):
            node.tag = "p"
        if node.tag in ("section", "h2", "h3", "h4", "h5", "h6", "p", "td", "pre"):
            out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def _tidy(article: Node, weigh: bool) -> None:
    """A second look at tables, lists and boxes: out with those that are links, forms or fragments."""
    for node in [n for n in article.walk() if n.tag in ("fieldset", "table", "ul", "div")][::-1]:
        text = _inner(node)
        items = node.find("li")
        is_list = node.tag in ("ul", "ol") or (bool(text) and sum(len(_inner(x)) for n in node.find("ul", "ol") for x in [n]) / len(text) > 0.9)
        if node.tag == "table" and (node.find("caption", "thead", "th", "col", "tfoot") or len(node.find("tr")) >= 10):
            continue
        if any(a.tag in ("code", "table") for a in node.ancestors()) or any(n.tag == "code" for n in node.walk()):
            continue
        weight = _weight(node, weigh)
        if weight < 0:
            node.remove()
            continue
        if text.count(",") >= 10:
            continue
        p, img, inputs = len(node.find("p")), len(node.find("img")), len(node.find("input"))
        headings = sum(len(_inner(h)) for h in node.find("h1", "h2", "h3", "h4", "h5", "h6")) / len(text) if text else 0
        density = _link_density(node)
        figure = any(a.tag == "figure" for a in node.ancestors())
        if (img > 1 and p / img < 0.5 and not figure) or (not is_list and len(items) - 100 > p) or inputs > p // 3 or (not is_list and headings < 0.9 and len(text) < 25 and (img == 0 or img > 2) and not figure) or (not is_list and weight < 25 and density > 0.2) or (weight >= 25 and density > 0.5):
            node.remove()


def _grab(body: Node, title: str, unlikely: bool, weigh: bool, tidy: bool) -> Node:
    body = _copy(body)
    scored: list[Node] = []
    for node in _candidates(body, title, unlikely):
        text = _inner(node)
        if len(text) < 25 or node.parent is None:
            continue
        points = 1 + len(re.split("[,،﹐︐︑⹁⸴，]", text)) + min(len(text) // 100, 3)
        for level, a in enumerate(list(node.ancestors())[:5]):
            if a.tag in ("#root", "html"):
                break
            if a.points is None:
                a.points = _START.get(a.tag, 0) + _weight(a, weigh)
                scored.append(a)
            a.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
    for a in scored:
        a.points *= 1 - _link_density(a)
    scored.sort(key=lambda a: -a.points)
    article = Node("div")
    top = scored[0] if scored else None
    if top is not None and top.tag == "body":
        # Boxes around an article may lift the body over it; a lone article of most of the text is still the article.
        named = [a for a in scored if a.tag == "article"]
        if len(named) == 1 and 2 * len(_inner(named[0])) > len(_inner(top)):
            top = named[0]
    if top is None or top.tag == "body":
        article.children = body.children
    else:
        while top.parent.tag != "body" and sum(isinstance(c, Node) for c in top.parent.children) == 1:
            top = top.parent
        least = max(10, (top.points or 0) * 0.2)
        for s in [c for c in (top.parent.children if top.parent else [top]) if isinstance(c, Node)]:
            bonus = (top.points or 0) * 0.2 if s.attrs.get("class") and s.attrs.get("class") == top.attrs.get("class") else 0
            keep = s is top or (s.points is not None and s.points + bonus >= least)
            if not keep and s.tag == "p":
                density, text = _link_density(s), _inner(s)
                keep = (len(text) > 80 and density < 0.25) or (0 < len(text) < 80 and density == 0 and re.search(r"\.( |$)", text) is not None)
            if keep:
                article.children.append(s)
    for c in article.children:
        if isinstance(c, Node):
            c.parent = article
    if tidy:
        _tidy(article, weigh)
    for n in list(article.walk()):
        if n.tag in ("object", "embed", "footer", "link", "aside", "iframe") or (n.tag in ("h1", "h2") and _weight(n, weigh) < 0):
            n.remove()
        elif n.tag == "p" and not n.find("img", "embed", "object", "iframe") and not n.text().strip():
            n.remove()
        elif n.tag == "h1":
            n.tag = "h2"
    return article


def article_of(root: Node, title: str) -> Node | None:
    """The article's element, or None where a page has no text."""
    body = next((n for n in root.walk() if n.tag == "body"), root)
    tries = []
    for flags in ((True, True, True), (False, True, True), (False, False, True), (False, False, False)):
        found = _grab(body, title, *flags)
        size = len(_inner(found))
        if size >= _LEAST:
            return found
        tries.append((size, found))
    size, found = max(tries, key=lambda t: t[0])
    return found if size else None


# Markdown.

_ESCAPES = [(re.compile(p), r) for p, r in ((r"\\", r"\\\\"), (r"\*", r"\\*"), (r"^-", r"\\-"), (r"^\+ ", r"\\+ "), (r"^(=+)", r"\\\1"), (r"^(#{1,6}) ", r"\\\1 "), (r"`", r"\\`"), (r"^~~~", r"\\~~~"), (r"\[", r"\\["), (r"\]", r"\\]"), (r"^>", r"\\>"), (r"_", r"\\_"), (r"^(\d+)\. ", r"\1\\. "))]
_BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html isindex li main menu nav noframes noscript ol output p pre section table tbody td tfoot th thead tr ul #root".split())


def _collapse(root: Node) -> None:
    """White space as a browser shows it: runs are one space, none at the edges of blocks."""
    last: list = [None]  # where the last visible text stands: (children, index)

    def trim() -> None:
        if last[0] is not None:
            children, i = last[0]
            children[i] = children[i].rstrip(" ")
            last[0] = None

    def visit(node: Node, open_: bool) -> bool:
        # open_: whether a space may come next (there is text before it that does not end in one).
        if node.tag == "pre":
            trim()
            return False
        block = node.tag in _BLOCK_TAGS or node.tag == "br"
        if block:
            trim()
            open_ = False
        for i, c in enumerate(node.children):
            if isinstance(c, str):
                if c.startswith("\n\n$$\n"):
                    continue
                text = re.sub(r"[ \r\n\t]+", " ", c)
                if not open_ and text.startswith(" "):
                    text = text[1:]
                node.children[i] = text
                if text:
                    last[0] = (node.children, i)
                    open_ = not text.endswith(" ")
            else:
                open_ = visit(c, open_)
                if c.tag in _VOID and c.tag != "br":
                    last[0], open_ = None, True
        if block:
            trim()
            open_ = False
        return open_

    visit(root, False)


def _join(parts: list[str]) -> str:
    """Blocks meet at the longer of their blank lines, two at most."""
    out = ""
    for p in parts:
        head, tail = re.search(r"\n*$", out)[0], re.match(r"\n*", p)[0]
        out = out[: len(out) - len(head)] + "\n\n"[: max(len(head), len(tail))] + p[len(tail) :]
    return out


def _cell(text: str, first: bool) -> str:
    return ("| " if first else " ") + text.strip().replace("\n\r", "<br>").replace("\n", "<br>").replace("|", "\\|") + " |"


def _markdown(node: Node, without_images: bool, raw: bool = False) -> str:
    parts = []
    for c in node.children:
        if isinstance(c, str):
            text = c
            if not raw and not c.startswith("\n\n$$\n") and not re.fullmatch(r"\$[^$]+\$", c):
                for pattern, to in _ESCAPES:
                    text = pattern.sub(to, text)
            parts.append(text)
        else:
            parts.append(_element(c, without_images))
    return _join(parts)


def _element(node: Node, without_images: bool) -> str:
    tag = node.tag
    if tag == "pre" or (tag == "div" and "highlight" in node.classes):
        code = next(iter(node.find("code")), node)
        lang = _LANGUAGE.search(f"{node.attrs.get('class', '')} {code.attrs.get('class', '')}")
        return f"\n\n```{lang[1].lower() if lang else ''}\n{(code.text() or node.text()).replace(chr(13) + chr(10), chr(10)).strip()}\n```\n\n"
    if tag == "span" and (node.classes & {"katex", "MathJax", "math"} or "data-math" in node.attrs):
        note = next((n for n in node.find("annotation") if n.attrs.get("encoding") == "application/x-tex"), None)
        return f"${(node.attrs.get('data-math') or (note.text() if note else '') or node.text()).strip()}$"
    if tag in ("script", "style", "head", "title", "meta", "link"):
        return ""
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag == "img":
        alt, src = re.sub(r"\n\s*", "\n", node.attrs.get("alt", "")), node.attrs.get("src", "")
        if without_images:
            return f" *[Image: {alt.strip()}]* " if alt else ""
        title = f' "{node.attrs["title"]}"' if node.attrs.get("title") else ""
        return f"![{alt}]({src}{title})" if src else ""
    if tag == "code":
        code = node.text().replace("\n", " ")
        if not code.strip():
            return ""
        ticks = "`"
        while ticks in re.findall("`+", code):
            ticks += "`"
        pad = " " if re.search(r"^`|^ .*?[^ ].* $|`$", code) else ""
        return f"{ticks}{pad}{code}{pad}{ticks}"
    if tag == "input" and node.attrs.get("type") == "checkbox":
        return "[x] " if "checked" in node.attrs else "[ ] "
    inner = _markdown(node, without_images)
    if tag == "table":
        return f"\n\n{_table(node, without_images)}\n\n" if node.find("tr") else f"\n\n{inner}\n\n"
    if not inner.strip() and tag not in ("td", "th", "a", "iframe"):
        return "\n\n" if tag in _BLOCK_TAGS else inner
    if tag == "div" and node.classes & {"callout", "quote", "infobox-note"}:
        return "\n\n" + re.sub(r"^", "> ", inner.strip(), flags=re.M) + "\n\n"
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return f"\n\n{'#' * int(tag[1])} {inner}\n\n"
    if tag == "blockquote":
        return "\n\n" + re.sub(r"^", "> ", re.sub(r"^\n+|\n+$", "", inner), flags=re.M) + "\n\n"
    if tag in ("ul", "ol"):
        nested = node.parent is not None and node.parent.tag == "li" and [c for c in node.parent.children if isinstance(c, Node)][-1] is node
        return f"\n{inner}" if nested else f"\n\n{inner}\n\n"
    if tag == "li":
        return _item(node, inner)
    if tag in ("em", "i", "strong", "b", "del", "s", "strike"):
        mark = "*" if tag in ("em", "i") else "**" if tag in ("strong", "b") else "~"
        before, after = re.match(r"\s*", inner)[0], re.search(r"\s*$", inner)[0]
        return f"{before}{mark}{inner.strip()}{mark}{after}"
    if tag == "a" and node.attrs.get("href"):
        title = f' "{node.attrs["title"]}"' if node.attrs.get("title") else ""
        href = re.sub(r"([()])", r"\\\1", node.attrs["href"])
        return f"[{inner}]({href}{title})"
    return f"\n\n{inner}\n\n" if tag in _BLOCK_TAGS else inner


def _item(node: Node, inner: str) -> str:
    parent = node.parent
    mark = "-   "
    siblings = [c for c in parent.children if isinstance(c, Node)] if parent else [node]
    if parent is not None and parent.tag == "ol":
        start = parent.attrs.get("start", "")
        mark = f"{(int(start) if start.isdigit() else 1) + siblings.index(node)}.  "
    body = re.sub(r"\n+$", "\n", re.sub(r"^\n+", "", inner)).replace("\n", "\n    ")
    return mark + body + ("\n" if siblings[-1] is not node and not body.endswith("\n") else "")


def _table(node: Node, without_images: bool) -> str:
    lines = []
    for row in node.find("tr"):
        cells = [c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")]
        lines.append("".join(_cell(_markdown(c, without_images), i == 0) for i, c in enumerate(cells)))
        if len(lines) == 1:
            rule = {"left": ":--", "right": "--:", "center": ":-:"}
            lines.append("".join(_cell(rule.get(c.attrs.get("align", "").lower(), "---"), i == 0) for i, c in enumerate(cells)))
    return "\n".join(lines)


def to_markdown(node: Node, without_images: bool = False) -> str:
    """Markdown of an element's content."""
    _collapse(node)
    text = re.sub(r"^[\t\r\n]+|[\t\r\n\s]+$", "", _markdown(node, without_images))
    return re.sub(r"\[\s*\]\(\s*\)", "", re.sub(r"\n{3,}", "\n\n", text)).strip()


def to_html(node: Node) -> str:
    """The markup of an element's content."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(escape(c, quote=False))
        else:
            attrs = "".join(f' {k}="{escape(v)}"' for k, v in c.attrs.items() if k not in ("class", "style", "align"))
            out.append(f"<{c.tag}{attrs}>" + ("" if c.tag in _VOID else f"{to_html(c)}</{c.tag}>"))
    return "".join(out)


def _title(root: Node) -> str:
    """The page's title without the site's name around it."""
    node = next((n for n in root.walk() if n.tag == "title"), None)
    whole = cut = re.sub(r"\s+", " ", node.text()).strip() if node else ""
    words = lambda s: len(s.split())
    separated = re.search(r" [|\-\\/>»] ", whole) is not None
    if separated:
        cut = re.sub(r"(.*) [|\-\\/>»] .*", r"\1", whole, count=1)
        if words(cut) < 3:
            cut = re.sub(r"[^|\-\\/>»]*[|\-\\/>»](.*)", r"\1", whole, count=1)
    elif ": " in whole:
        if not any(h.text().strip() == whole for h in root.find("h1", "h2")):
            cut = whole[whole.rfind(":") + 1 :]
            if words(cut) < 3:
                cut = whole[whole.find(":") + 1 :]
            elif words(whole[: whole.find(":")]) > 5:
                cut = whole
    elif len(whole) > 150 or len(whole) < 15:
        heads = root.find("h1")
        if len(heads) == 1:
            cut = _inner(heads[0])
    cut = re.sub(r"\s{2,}", " ", cut.strip())
    if words(cut) <= 4 and (not separated or words(cut) != words(re.sub(r"[|\-\\/>»]+", "", whole)) - 1):
        cut = whole
    return cut


def read_article(html: str | None, url: str | None = None, without_images: bool = False, title: str | None = None) -> dict:
    """One page in reader mode: its metadata, Markdown, markup, words and what was pruned.

    An empty or null page gives the given title (or "Untitled Document"), no text and no counts.
    """
    if not (html or "").strip():
        return {"title": title or "Untitled Document", "byline": None, "site_name": None, "published": None, "excerpt": None, "markdown": "", "html": "", "words": 0, "reading_minutes": 0, "pruned": 0, "ads_removed": 0, "is_article": False}
    page = Page(parse(html))
    root = page.root
    metas: dict[str, str] = {}
    for m in root.find("meta"):
        for key in (m.attrs.get("name"), m.attrs.get("property")):
            if key and m.attrs.get("content", "").strip():
                metas.setdefault(key.lower(), m.attrs["content"].strip())
    pruned, ads = clean(page, url)
    found_title = metas.get("og:title") or metas.get("twitter:title") or _title(root)
    article = article_of(root, found_title)
    if article is not None and url:
        for a in article.find("a", "img"):
            key = "href" if a.tag == "a" else "src"
            if a.attrs.get(key) and not a.attrs[key].startswith("#"):
                try:
                    a.attrs[key] = urljoin(url, a.attrs[key])
                except ValueError:
                    pass
    body = article if article is not None else next((n for n in root.walk() if n.tag == "body"), root)
    first = next(iter(body.find("p")), None)
    plain = _inner(article) if article is not None else ""
    markup = to_html(body)
    markdown = to_markdown(body, without_images)
    if article is None:
        plain = re.sub(r"[#*`_\[\]()]", " ", markdown)
    times = root.find("time")
    heading = next(iter(root.find("h1")), None)
    name = urlsplit(url).hostname if url else None
    words = len(plain.split())
    return {
        "title": re.sub(r"\s+", " ", found_title or (heading.text() if heading else "") or title or "Web Document").strip(),
        "byline": metas.get("author") or metas.get("article:author"),
        "site_name": metas.get("og:site_name") or (re.sub(r"^www\.", "", name) if name else None),
        "published": metas.get("article:published_time") or (times[0].attrs.get("datetime") if times else None),
        "excerpt": metas.get("description") or metas.get("og:description") or (_inner(first) if article is not None and first else None),
        "markdown": markdown, "html": markup, "words": words, "reading_minutes": max(1, -(-words // 200)), "pruned": pruned, "ads_removed": ads,
        "is_article": article is not None and _BOX + len(markup.strip()) > 100,
    }


_FIELDS = [("title", pa.string()), ("byline", pa.string()), ("site_name", pa.string()), ("published", pa.string()), ("excerpt", pa.string()), ("markdown", pa.string()), ("html", pa.string()), ("words", pa.int64()), ("reading_minutes", pa.int64()), ("pruned", pa.int64()), ("ads_removed", pa.int64()), ("is_article", pa.bool_())]
_DDL = "title string, byline string, site_name string, published string, excerpt string, markdown string, html string, words long, reading_minutes long, pruned long, ads_removed long, is_article boolean"


def reader_articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", without_images: bool = False) -> DataFrame:
    """page_id, url and the fields of ``read_article`` of every page. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read_article(h, u, without_images) for h, u in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([f[n] for f in found], t) for n, t in _FIELDS)], ["page_id", "url", *(n for n, _ in _FIELDS)])

    bound_batches(pages.sparkSession)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return base.mapInArrow(run, f"page_id long, url string, {_DDL}")
