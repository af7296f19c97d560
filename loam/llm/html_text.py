"""HTML extraction by composite text density.

Each page becomes a DOM tree (comments, scripts, styles and the like never enter it; missing end tags are implied; elements
nested deeper than DEEPEST stand beside each other, as in browsers). The tree is read in one pass: no markup makes it
look at a character again and again. Elements whose tag, role, class or id says that they are no article text (menus, page headers,
footers, sidebars, notices, adverts, forms, reader comments) are cut off, unless they hold what text there is: see `cut_marked`.
Every node then has a composite density: characters per tag,
raised or lowered by the share of characters and tags in links as against the whole body. The node with the largest
sum of child densities is where the text is; the smallest density on its path to the body is the threshold. The
outermost article or main element around that node is taken whole; subtrees outside it must reach the threshold to be
taken as well. All text of the chosen subtrees is kept, block by block.

Defined results: null or empty html, or a page without text: the empty string. Broken markup is read as a browser
would, as far as nesting goes. Of nodes with equal sums the first in page order counts. Repeated rows give repeated results;
extra columns are ignored, clashing names too; an empty table gives no rows. A page is held whole, with about 50 bytes a
character of markup."""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_arrow_batches
from .text import give_back

# Fixed values of HTML: elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp".split())
# These are left out as well, where they end.
SKIPPED = frozenset("noscript template svg math object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption body head html legend optgroup option tbody td tfoot th thead tr".split())
#: An element of the first kind ends an open one of the second, within the third.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
}
# Chosen, not fixed: what marks an element as no part of the article. FORM wraps whole pages at times.
OTHER_TAGS = frozenset("nav footer aside button select dialog menu".split())
FORM = "form"
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored sponsors promo promoted promotion banner breadcrumb breadcrumbs menu menus nav navbar navigation sidebar sidebars footer topbar masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments disqus replies respond reply share sharing social related recommended widget widgets toolbar pagination pager skip".split()
)
#: Parts that may stand beside such a name in a class or id that still says what the element is.
PLAIN_PARTS = frozenset("area bar block body box button buttons column container content footer global header inner item items left links list main outer page right section site text top bottom wrap wrapper thread form".split())
#: Classes and ids of the article itself.
OWN_NAMES = frozenset("article content entry main post story text body page container wrapper content-area main-content page-content post-content entry-content article-content article-body post-body entry-body story-body main-text article-text".split())
#: Parts of a class or id by which it tells what a page has or lacks, not what the element is.
STATES = frozenset("no not has with without enabled disabled".split())
#: Shares of the text around that keep an element whose name is doubtful, or certain.
HALF, ALL = 0.5, 0.95

# Quotes count in values only; possessive, so that no character is tried twice.
ATTRIBUTES = re.compile(r"(?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+>", re.S)
NAME = re.compile(r"[A-Za-z][^\s/>\x00]*")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|$)", re.I)
PART = re.compile(r"[a-z]+")
DEEPEST = 512


class Node:
    """An element; `mark` is None, or the share of the text around that keeps it (2: none does)."""

    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "sum", "inside", "mark", "articles", "depth", "clear")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.mark: float | None = None
        self.articles, self.clear = 0, False
        self.depth = parent.depth + 1 if parent is not None else 0
        self.inside = tag in ("article", "main") or parent is not None and parent.inside


def mark_of(tag: str, attributes: str, inside: bool) -> float | None:
    """What an element's tag, role, class or id makes of it. inside: within an article or main element, whose own header belongs to it."""
    if tag in OTHER_TAGS or (tag == "header" and not inside):
        return ALL
    mark = HALF if tag == FORM else None
    if not attributes:
        return mark
    own = tag in ("article", "main")
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value.strip() in OTHER_ROLES:
            mark = ALL
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return 2.0
        elif name in ("class", "id"):
            for word in value.split():
                own = own or word in OWN_NAMES
                parts = PART.findall(word)
                if OTHER_NAMES.isdisjoint(parts) or not STATES.isdisjoint(parts):
                    continue
                certain = all(x in OTHER_NAMES or x in PLAIN_PARTS for x in parts)
                mark = max(mark or 0, ALL if certain else HALF)
    return HALF if mark is not None and own else mark


def cut_marked(body: Node) -> None:
    """Cuts what is marked: from the outermost inwards, each marked element whose text outside links is no larger than its
    mark's share of the nearest article's or, without one, the body's. So a doubtful name (`post related-content`) does not cut
    half the article, and no name all of a page. An element without an article or main element goes where the page has one
    elsewhere; one that holds every one of them stays."""
    order, stack = [], [(body, False)]
    while stack:
        node, link = stack.pop()
        order.append(node)
        link = link or node.tag == "a"
        for p in node.parts:
            if isinstance(p, Node):
                stack.append((p, link))
            elif not link:
                node.chars += len("".join(p.split()))
    for node in reversed(order):
        if node.tag in ("article", "main") and node.mark is None:
            node.articles += 1
        if node.parent is not None:
            node.parent.articles += node.articles
            if node.mark != 2.0:
                node.parent.chars += node.chars
    stack = [(body, body)]
    while stack:
        node, scope = stack.pop()
        if node.articles and node.tag in ("article", "main"):
            scope = node
        kept = []
        for p in node.parts:
            if isinstance(p, Node):
                if p.mark is not None:
                    if body.articles and not scope.inside:
                        stays = p.mark != 2.0 and p.articles == body.articles
                    else:
                        stays = p.chars > p.mark * scope.chars
                    if not stays:
                        continue
                stack.append((p, scope))
            kept.append(p)
        node.parts = kept
    for node in order:
        node.chars = 0


def parse(page: str) -> Node:
    """The page's body as a tree without the elements that are no article text."""
    body = at = Node("body", None)
    pos, end, last = 0, len(page), page.rfind(">")
    count: dict[str, int] = {}  # open elements by tag
    endless: set[str] = set()  # tags of which no end follows
    lenient = False  # a tag was found that only the page's end would close

    def up_to(node: Node) -> None:
        """Ends all open elements below `node`."""
        nonlocal at
        while at is not node:
            count[at.tag] -= 1
            at = at.parent

    while pos < end:
        start = page.find("<", pos)
        if start < 0 or start > last:
            at.parts.append(page[pos:])
            break
        if start > pos:
            at.parts.append(page[pos:start])
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            pos = close + 3 if close >= 0 else end
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            pos = page.find(">", start) + 1
            continue
        ends_one = page.startswith("/", start + 1)
        name = NAME.match(page, start + 1 + ends_one)
        if name is None:
            at.parts.append("<")
            pos = start + 1
            continue
        whole = None if lenient else ATTRIBUTES.match(page, name.end())
        if whole is None:
            lenient = True
            pos = page.find(">", name.end()) + 1
            if not pos:
                at.parts.append(page[start:])
                break
        else:
            pos = whole.end()
        attributes, tag = page[name.end() : pos - 1], name[0].lower()
        if tag in ("html", "body", "head"):
            continue
        if ends_one:
            if count.get(tag):
                node = at
                while node.tag != tag:
                    node = node.parent
                up_to(node.parent)
            elif tag == "p":
                Node("p", at)
            continue
        closed = attributes.rstrip().endswith("/")
        if (tag in RAW or tag in SKIPPED) and not closed and tag not in endless:
            close = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, pos)
            if close or tag in RAW:
                pos = close.end() if close else end
                continue
            endless.add(tag)
        if tag in CLOSES_P and count.get("p") and not at.clear:
            node = at
            while node is not body and node.tag not in ("p", "td", "th", "table", "button", "object", "caption") and node.tag not in CLOSES_P:
                node = node.parent
            if node.tag == "p":
                up_to(node.parent)
            else:
                at.clear = True
        if tag in IMPLIED:
            ends, within = IMPLIED[tag]
            node, outer, left = at, None, sum(count.get(x, 0) for x in ends)
            while left and node.tag not in within:
                if node.tag in ends:
                    outer, left = node, left - 1
                node = node.parent
            if outer is not None:
                up_to(outer.parent)
        if tag in VOID or closed and tag not in BLOCK:
            at.parts.append("\n" if tag == "hr" else " ")
            if tag == "hr":
                at.parts.append(Node("hr", at))
            continue
        if at.depth >= DEEPEST:
            up_to(at.parent)
        node = Node(tag, at)
        node.mark = mark_of(tag, attributes, at.inside)
        at.parts.append(node)
        count[tag] = count.get(tag, 0) + 1
        at = node
    cut_marked(body)
    return body


def composite(chars: float, tags: float, link_chars: float, link_tags: float, plain_chars: float, share: float) -> float:
    """The composite density of a node: characters per tag, times the logarithm of (characters per link character) times (tags
    per link tag) to the base ln(chars / plain_chars * link_chars + share * chars + e), `share` being the body's share of
    characters in links. Counts are at least 1; below 0 it counts as 0."""
    base = math.log(chars / plain_chars * link_chars + share * chars + math.e)
    return max(0.0, chars / tags * math.log(chars / link_chars * (tags / link_tags)) / math.log(base))


def measure(body: Node) -> list[Node]:
    """Sets counts and densities; all nodes, parents first."""
    order, stack = [], [(body, False)]
    while stack:
        node, link = stack.pop()
        order.append(node)
        link = link or node.tag == "a"
        for p in node.parts:
            if isinstance(p, Node):
                stack.append((p, link))
            else:
                n = len("".join(p.split()))
                node.chars += n
                if link:
                    node.link_chars += n
        if link:
            node.link_tags += 1
    for node in reversed(order):
        for p in node.parts:
            if isinstance(p, Node):
                node.chars += p.chars
                node.tags += p.tags + 1
                node.link_chars += p.link_chars
                node.link_tags += p.link_tags
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            node.density = composite(c, t, lc, lt, max(c - node.link_chars, 1), share)
        node.sum = sum(p.density for p in node.parts if isinstance(p, Node))
    return order


def blocks(node: Node, out: list[list[str]]) -> None:
    """Appends the node's text, a list of pieces for each block."""
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        else:
            edge = [None] if x.tag in BLOCK else []
            stack += [*edge, *reversed(x.parts), *edge]


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    body = parse(page)
    order = measure(body)
    if not body.chars:
        return ""
    best = max(order, key=lambda n: n.sum)
    if not best.sum:
        best = max(order, key=lambda n: n.density)
    threshold, node = best.density, best
    while node is not None:
        threshold = min(threshold, node.density)
        if node.tag in ("article", "main"):
            best = node
        node = node.parent
    # subtrees reaching the threshold: of each, the node with the largest sum; nested ones count once
    chosen, stack, path = [], [body], set()
    node = best
    while node is not None:
        path.add(id(node))
        node = node.parent
    while stack:
        x = stack.pop()
        if x is best or (id(x) not in path and x.density >= threshold and x.density > 0):
            chosen.append(x)
        elif id(x) in path:
            stack += [p for p in reversed(x.parts) if isinstance(p, Node)]
    out: list[list[str]] = [[]]
    for x in chosen:
        out.append([])
        blocks(x, out)
    lines = (" ".join(html.unescape("".join(pieces)).split()) for pieces in out)
    return "\n".join(line for line in lines if line)


def extract_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars)."""
    small_arrow_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col(column).cast("string").alias("html"))
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([extract(h) for h in batch.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])
        give_back()

    out = rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
