"""HTML extraction: composite text density.

Each page is parsed into a tree of elements. Elements that can't be the article by their tag, role or whole class name
(menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, readers' comments) are cut; a class
name counts only if all its words are such words or words of layout, so `related-work` or `no-sidebar` cuts nothing.
For every node that is left the link-adjusted characters per tag are computed; the density sum of a node that can hold
blocks is that of its children. The node with the largest sum is content, whatever its tag; the smallest density on its path from body is the
threshold. From body down every node that reaches the threshold and is not mostly links gives its own node of the largest sum, and all these
are kept with the text, headings and blocks (not mostly links) that stand beside them below their common ancestor; beside
them in body itself only blocks of running text are. White space inside a block becomes one space, blocks are joined by
a line feed, character references are decoded.

A null or empty page, or one with no text outside boilerplate, gives an empty text. Unclosed and misnested tags are
repaired as browsers do for paragraphs, lists and tables; where a quote in a tag never ends, quotes mean nothing from
there on. The work is linear in the page, however deep or broken it is. Rows that repeat are extracted each.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: What an open element of the key's kind is closed by.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "td", "main"}
CUT_TAGS = {"nav", "footer", "aside", "form", "head", "button", "select", "menu", "dialog", "svg", "object", "canvas", "audio", "video", "search"}
CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
CUT_WORDS = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe signup share sharing social recommended pagination pager toolbar login disclaimer".split())
COMMENT_WORDS = {"comment", "comments", "respond", "replies", "disqus"}
#: Words that say nothing of what an element is; a name of these and one of the above is still a name for boilerplate.
LAYOUT_WORDS = set("site page top bottom left right main global primary secondary bar box block container wrapper wrap inner outer list item items links link buttons button icons section area slot unit widget message text content header posts panel column col row bg js".split())
#: Names that are boilerplate only as a whole.
CUT_NAMES = {"header", "site-header", "page-header", "top-header", "top-bar", "related", "related-posts", "related-articles", "related-links", "skip", "skip-link", "skip-to-content", "widget", "discussion"}
TITLES = ("h1", "h2", "header", "hgroup")
#: Blocks of running text; those that stand beside kept nodes stay even when short.
PLAIN = set("p pre blockquote ul ol dl table figure h1 h2 h3 h4 h5 h6 header hgroup address".split())
CUTS, COMMENTS = frozenset(CUT_WORDS | COMMENT_WORDS), frozenset(COMMENT_WORDS)
#: What can be a subtree of blocks; a paragraph with marked-up words is none, however dense they are.
CONTAINER = BLOCK - set("p pre h1 h2 h3 h4 h5 h6 hgroup hr address dt caption figcaption summary legend".split()) | {"html", "td", "th"}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|aria-hidden|hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORDS = re.compile(r"[a-z]+|[^a-z\-_]+")


DEPTH = attrgetter("depth")


@cache
def raw_end(tag: str) -> re.Pattern:
    return re.compile(f"(?i)</{tag}[\\s/>]")


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "depth", "named", "holds", "inside", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, attributes: str, parent: "Node | None"):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.depth = parent.depth + 1 if parent else 0


class Parser:
    """Where tags end and which elements are open, each found without walking the page or the open elements again."""

    def __init__(self, page: str):
        self.page, self.quotes, self.last = page, True, page.rfind(">")
        self.root = self.here = Node("html", "", None)
        self.open: dict[str, list[Node]] = {}
        self.scopes = [0]

    def tag_end(self, at: int) -> int:
        """The first > outside quotes, or the first at all; -1 if there is none."""
        if at > self.last:
            return -1
        i = at
        while self.quotes and (m := END.search(self.page, i)):
            if m[0] == ">":
                return m.start()
            i = self.page.find(m[0], m.end()) + 1
            self.quotes = i > 0
        self.quotes = False
        return self.page.find(">", at)

    def push(self, node: Node) -> None:
        self.here = node
        self.open.setdefault(node.tag, []).append(node)
        if node.tag in SCOPE:
            self.scopes.append(node.depth)

    def close(self, node: Node) -> None:
        """Close the open element and all inside it."""
        while self.here.depth >= node.depth:
            self.open[self.here.tag].pop()
            if self.here.tag in SCOPE:
                self.scopes.pop()
            self.here = self.here.parent

    def outermost(self, tags: set[str]) -> Node | None:
        """The outermost open element of these tags inside the innermost scope; that scope's own element counts."""
        least = self.scopes[-1]
        found = [nodes[i] for t in tags if (nodes := self.open.get(t)) and (i := bisect_left(nodes, least, key=DEPTH)) < len(nodes)]
        return min(found, key=DEPTH, default=None)


def parse(page: str) -> Node:
    parser = Parser(page)
    root = parser.root
    at, n, bodies = 0, len(page), 0
    while at < n:
        less = page.find("<", at)
        if less < 0:
            less = n
        if less > at:
            parser.here.children.append(page[at:less])
        if less >= n:
            break
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), less):
            end = page.find(">", less)
            at = n if end < 0 else end + 1
            continue
        closing = page.startswith("</", less)
        m = NAME.match(page, less + 1 + closing) if less <= parser.last else None
        end = parser.tag_end(less) if m else -1
        if end < 0:
            parser.here.children.append("<")
            at = less + 1
            continue
        tag, at = m[0].lower(), end + 1
        if closing:
            same = parser.open.get(tag)
            if same and (tag in BLOCK or same[-1].depth >= parser.scopes[-1]):
                parser.close(same[-1])
            continue
        attributes = page[min(m.end(), end) : end]
        if tag == "html" or tag == "body" and bodies:
            continue
        bodies += tag == "body"
        if tag in RAW:
            close = raw_end(tag).search(page, at)
            parser.here.children.append(Node(tag, attributes, parser.here))
            stop = n if not close else close.start()
            at = n if not close else max(stop, page.find(">", stop)) + 1
            continue
        if tag in CLOSES or tag in BLOCK:
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
            if tag[0] == "h" and tag[1:].isdigit():
                ends = ends | {"h1", "h2", "h3", "h4", "h5", "h6"}
            if tag == "body":
                ends = {"head"}
            if last := parser.outermost(ends):
                parser.close(last)
        node = Node(tag, attributes, parser.here)
        parser.here.children.append(node)
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            parser.push(node)
    return root


def named(node: Node) -> dict[str, str]:
    found: dict[str, str] = {}
    if node.attributes:
        for m in ATTRIBUTE.finditer(node.attributes):
            found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return found


def names(node: Node) -> list[str]:
    return f"{node.named.get('class', '')} {node.named.get('id', '')}".split()


@cache
def is_name(name: str, words: frozenset[str]) -> bool:
    """Whether one word of the name at least is of these, and the others are too or are words of layout."""
    own = WORDS.findall(name)
    return any(w in words for w in own) and all(w in words or w in LAYOUT_WORDS or w.isdigit() for w in own)


def comments(node: Node) -> bool:
    return any(is_name(x, COMMENTS) for x in names(node))


def boilerplate(node: Node) -> bool:
    if node.tag in CUT_TAGS or node.tag in RAW:
        return True
    if node.named.get("aria-hidden") == "true" or node.named.get("role") in CUT_ROLES:
        return True
    if node.tag == "header":
        return not (node.inside or node.holds)
    if node.tag in ("html", "body", "main") or node.tag in TITLES or node.holds:
        return False
    if comments(node):
        return True
    return node.tag != "article" and any(x in CUT_NAMES or is_name(x, CUTS) for x in names(node))


def describe(root: Node) -> None:
    """Of every node its named attributes, whether it holds an article that is no reader's comment or main, and whether it stands in one."""
    nodes = in_order(root)
    for node in nodes:
        node.named, node.holds = named(node), False
        node.inside = bool(node.parent) and (node.parent.inside or node.parent.tag in ("article", "main"))
    for node in reversed(nodes):
        if node.parent and (node.holds or node.tag == "main" or node.tag == "article" and not comments(node)):
            node.parent.holds = True


def in_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def measure(body: Node) -> list[Node]:
    """Densities of all nodes; children come after their parents in the list."""
    nodes = in_order(body)
    for node in reversed(nodes):
        node.chars = node.link_chars = 0
        node.tags, node.link_tags = 0, 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(" ".join(c.split()))
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        c, t = node.chars, max(1, node.tags)
        lc, lt = max(1, node.link_chars), max(1, node.link_tags)
        base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
        ratio = c / lc * t / lt
        node.density = c / t * math.log(ratio) / math.log(base + 1e-9) if c and ratio > 1 and base > 1 else float(c / t if c and base <= 1 else 0)
    for node in nodes:
        node.total = sum(c.density for c in node.children if isinstance(c, Node)) if node.tag in CONTAINER else 0.0
    return nodes


def blocks(node: Node) -> str:
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if text := " ".join(html.unescape("".join(parts)).split()):
            out.append(text)
        parts.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif x.tag == "br" or x.tag in ("td", "th"):
            parts.append(" ")
            todo += reversed(x.children)
        elif x.tag in BLOCK:
            flush()
            todo.append(None)
            todo += reversed(x.children)
        else:
            todo += reversed(x.children)
    flush()
    return "\n".join(out)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    describe(root)
    strip(root, boilerplate)
    body = next((c for c in root.children if isinstance(c, Node) and c.tag == "body"), root)
    nodes = measure(body)
    best = max(nodes, key=lambda x: x.total)
    if best.total <= 0:
        best = body
    kept = reaching(body, min(x.density for x in path(best, body)))
    top = common(nodes, kept)
    beside = PLAIN if top is body else BLOCK
    while top is not body and all(isinstance(c, str) and not c.strip() or c is top or isinstance(c, Node) and c.tag in TITLES for c in top.parent.children):
        top = top.parent
    prune(top, kept, beside)
    return blocks(top)


def path(node: Node, body: Node) -> list[Node]:
    out = [node]
    while out[-1] is not body:
        out.append(out[-1].parent)
    return out


def strip(root: Node, cut) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not cut(c)]
        todo += [c for c in node.children if isinstance(c, Node)]


def reaching(bound: Node, threshold: float) -> set[Node]:
    """From the bound down, in every node that reaches the threshold, the node with the largest density sum."""
    largest: dict[Node, Node] = {}
    for node in reversed(in_order(bound)):
        largest[node] = max((node, *(largest[c] for c in node.children if isinstance(c, Node))), key=lambda x: x.total)
    kept: set[Node] = set()
    todo = [bound]
    while todo:
        node = todo.pop()
        if node not in kept and node.chars and node.density >= threshold and 2 * node.link_chars <= node.chars:
            kept.add(largest[node] if largest[node].total > 0 else node)
            if node not in kept:
                todo += [c for c in node.children if isinstance(c, Node)]
    return kept or {bound}


def common(nodes: list[Node], kept: set[Node]) -> Node:
    """The lowest node that holds all of them."""
    below = {x: 0 for x in nodes}
    for node in reversed(nodes):  # children come before their parents
        below[node] += node in kept
        if below[node] == len(kept):
            return node
        below[node.parent] += below[node]
    return nodes[0]


def prune(top: Node, kept: set[Node], plain: set[str]) -> None:
    """Of what lies above the kept nodes, leave loose text with its inline elements, and blocks of the plain tags that are not mostly links."""
    above: set[Node] = set()
    for node in kept:
        while node is not top and (node := node.parent) not in above:
            above.add(node)
    todo = [top]
    while todo:
        node = todo.pop()
        if node in kept:
            continue
        inline = [c for c in node.children if isinstance(c, Node) and c.tag not in BLOCK]
        loose = sum(len(c.strip()) for c in node.children if isinstance(c, str)) > sum(c.link_chars for c in inline)
        node.children = [c for c in node.children if isinstance(c, str) or c in kept or c in above or (c.tag in plain and 2 * c.link_chars <= c.chars if c.tag in BLOCK else c.tag in VOID or loose or not c.link_chars)]
        todo += [c for c in node.children if isinstance(c, Node) and c in above]


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([main_text(x) for x in batch.column("html").to_pylist()], pa.string())], names=["row", "main_text"])


def extract(pages: DataFrame) -> DataFrame:
    """(row, main_text): `row` holds the other columns of pages, so no name can clash."""
    inner = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns if c != "html")).alias("row"), "html")
    return inner.mapInArrow(texts, inner.select("row").schema.add("main_text", "string"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
