"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Every paragraph passes points (one, one for each comma, and one for each 100
characters up to three, less its share of link text) to its parent, half of them to the grandparent and ever
smaller parts to further ancestors. A container's points are discounted by its own link density. The container
with most points is kept, and of its siblings the headings, other containers with a fifth of its points and
long paragraphs with few links. Menus, headers, footers, sidebars, forms, scripts, styles and elements whose
class, id or role says that they are notices, adverts, comments or the like never score and are not printed.

Broken markup: unclosed and stray tags are tolerated as browsers do in the common cases (a new paragraph or
list item ends the open one, an end tag closes up to its element if that is open, a quote inside an unquoted value is part of
it). A cut-off tag at the end is
dropped. Edge cases: null or empty html gives an empty text; a page without markup is one block; a page whose
paragraphs are all too short to score keeps its unmarked content. An empty table gives no rows; repeated rows and ids
are pages of their own, other columns are ignored. Nothing is cut off, however long; time is linear in a page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
JUNK = frozenset("nav header footer aside form button select option input label fieldset dialog menu object canvas audio video head".split()) | RAW
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_JUNK_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|newsletter|subscri\w*|popup|modal|overlay|"
    r"comments?|disqus|replies|respond|sidebar|widget|related|recommend\w*|sharing|social|menu|nav\w*|breadcrumbs?|pagination|pager|"
    r"masthead|footer|copyright|login|signup|toolbar)(?:$|[\s_-])",
    re.I,
)
# Words that also name parts of an article: inside one they count as a whole name only, not as a part ("side-note").
_WEAK_NAME = "notice alert side share search skip hidden header foot".split()
_WEAK_PART = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(_WEAK_NAME)})(?:$|[\s_-])", re.I)
_WEAK_WHOLE = re.compile(rf"(?:^|\s)(?:{'|'.join(_WEAK_NAME)})(?:$|\s)", re.I)
_JUNK_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)*)(>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "items", "junk", "in_article", "points", "passed", "text_len", "link_len")

    def __init__(self, tag: str, parent: Node | None, junk: bool):
        self.tag, self.parent, self.junk = tag, parent, junk
        self.in_article = tag in ("article", "main") or parent is not None and parent.in_article
        self.items: list[Node | str] = []
        self.points = self.passed = 0.0
        self.text_len = self.link_len = 0


def _is_junk(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in JUNK and not (tag == "header" and in_article):  # an article's header holds its heading
        return True
    weak = _WEAK_WHOLE if in_article else _WEAK_PART
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in _NAMES.findall(attrs):
        name, value = name.lower(), next(filter(None, values), "")
        if name in ("class", "id") and (_JUNK_NAME.search(value) or weak.search(value)) or name == "role" and value.lower() in _JUNK_ROLE:
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def parse(page: str) -> Node:
    """The tree of a page; text items are decoded."""
    root = at = Node("#root", None, False)
    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.search(page, pos)
        text = page[pos : m.start() if m else size]
        if text:
            at.items.append(html.unescape(text))
        if not m:
            break
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                at.items.append(m[0][9:].removesuffix("]]>"))
            continue
        if not m[4]:
            break  # the page ends inside a tag
        if m[1]:
            up = at
            while up.parent and up.tag != tag:
                if up.tag in ("table", "td", "th") and tag in INLINE | {"p", "li"}:
                    up = root
                    break
                up = up.parent
            if up.parent:
                at = up.parent
            continue
        if tag in ENDS_P:
            up = at
            while up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                at = up.parent
        if tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
            up, stop = at, {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table", "tbody", "thead", "tfoot"), "option": ("select",)}[tag]
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            while up.parent and up.tag not in stop and up.tag not in same:
                up = up.parent
            if up.tag in same:
                at = up.parent
        node = Node(tag, at, at.junk or _is_junk(tag, m[3], at.in_article))
        at.items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else size
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            at = node
    return root


def _walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(x for x in reversed(node.items) if isinstance(x, Node) and not x.junk)


def _own(node: Node) -> tuple[str, int]:
    """Text of a node with its inline children but not its blocks, and how much of it is link text."""
    parts, links, stack = [], 0, [(x, False) for x in reversed(node.items)]
    while stack:
        x, link = stack.pop()
        if isinstance(x, str):
            parts.append(x)
            links += len(x.strip()) if link else 0
        elif not x.junk and x.tag in INLINE:
            stack.extend((y, link or x.tag == "a") for y in reversed(x.items))
        elif x.tag == "br":
            parts.append(" ")
    return _WHITE.sub(" ", "".join(parts)).strip(), links


def _score(root: Node, least: int) -> Node | None:
    def block(n: Node) -> Node | None:
        up = n.parent
        while up and up.tag in INLINE:
            up = up.parent
        return up

    order = [n for n in _walk(root) if n.tag not in INLINE]
    for n in order:
        n.points = n.passed = 0.0
        text, links = _own(n)
        n.text_len, n.link_len = len(text), min(links, len(text))
    for n in reversed(order):  # children stand behind their parents
        if up := block(n):
            up.text_len += n.text_len
            up.link_len += n.link_len
    for n in order:
        if n.tag in ("#root", "html", "body"):
            continue
        text, links = _own(n)
        if len(text) < least:
            continue
        points = (1 + sum(text.count(c) for c in ",،、，") + min(3, len(text) // 100)) * (1 - min(1.0, links / len(text)))
        if up := block(n):
            up.points += points
    for n in reversed(order):
        n.points += n.passed
        if up := block(n):
            up.passed += 0.5 * (n.points - n.passed) + n.passed / 3
    for n in order:
        if n.tag in ("article", "main"):
            n.points *= 1.25
        n.points *= 1 - n.link_len / max(1, n.text_len)
    best = max((n for n in order if n.tag not in HEADINGS), key=lambda n: n.points)
    return best if best.points > 0 else None


def _blocks(node: Node, out: list[str]) -> None:
    """Texts of a node's blocks in page order."""
    run: list[str] = []

    def end() -> None:
        if text := _WHITE.sub(" ", "".join(run)).strip():
            out.append(text)
        run.clear()

    stack: list[Node | str | None] = [node]  # None ends a block
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif x.junk:
            if x.tag not in INLINE | {"input", "button", "label", "select"}:
                end()
        elif x.tag in INLINE:
            stack.extend(reversed(x.items))
        else:
            end()
            stack.append(None)
            stack.extend(reversed(x.items))
    end()


def main_text(page: str | None, least: int = 25) -> str:
    """The blocks of the main text, joined by two line ends."""
    if not page:
        return ""
    root = parse(page)
    best = _score(root, least) or _score(root, 1)
    kept = [best or root]  # without a single paragraph element, all unmarked text
    article = best
    while article and article.tag != "article":
        article = article.parent
    if not article and best and best.in_article:
        article = best
        while article.tag != "main":
            article = article.parent
    if article:
        kept = [article]
    elif best and best.parent:
        siblings = [x for x in best.parent.items if isinstance(x, Node)]
        kept = []
        for x in siblings:
            density = x.link_len / max(1, x.text_len)
            good = x.points >= max(10, 0.2 * best.points) or x.tag in HEADINGS or x.tag == "p" and x.text_len > 80 and density < 0.25
            if x is best or good and not x.junk:
                kept.append(x)
    out: list[str] = []
    for x in kept:
        _blocks(x, out)
    return "\n\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string")
