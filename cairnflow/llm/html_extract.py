"""Main text of web pages by composite text density.

A tolerant parser reads a page's tags into a tree: raw text elements, comments, omitted end tags and unclosed
elements are handled as browsers do. Elements that are no article by their kind (menus, headers, footers, asides, forms,
scripts), by their role or because they are hidden are left out first. Every remaining block has a link-adjusted density of
characters a tag, inline elements not counting as tags; a block's density sum adds up those of the blocks right below
it. The block with the largest sum is found, the least density on its path up to the body is the threshold, and
in each branch beside the path that reaches the threshold the subtree with the largest density sum is content too,
as are headings beside it. The text of content subtrees is given in page order, white space within a block as one
space, blocks joined by one space.

Density decides; names (words of class and id such as `sidebar` or `comments`) only take away from what it finds: a block with
such a name beside the densest path or inside the densest subtree is left out, and where the densest path itself leads
through one, that block goes and the densest path is looked for anew. A named block that holds every main heading,
article or main element of the page, or more than ESSENTIAL of its text, is the page's frame and stays.

Nulls, empty pages and pages without text give the empty text. Rows do not depend on each other; repeated rows each
get their result, empty tables an empty one, the first of equally dense blocks is taken, and other columns are not read.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairnflow.llm.common import map_rows

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript template svg math".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NODES = BLOCK - {"br", "hr"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = frozenset("nav header footer aside form script style noscript template iframe svg math button select textarea input label dialog menu object embed canvas audio video head title".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions banner "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead footer foot copyright colophon "
    "sidebar aside rail widget widgets related recommended recommendations trending popular "
    "comment comments commentlist respond reply replies disqus discussion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login "
    "share sharing social toolbar form search skip".split()
)
LEFT_OUT_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related".split())
#: A named block with more than this share of the page's text that is no link is never left out for its name.
ESSENTIAL = 0.8
#: Elements that tell where the article is.
LANDMARKS = frozenset("article main h1".split())
#: A word after one of these tells of a neighbour, as in `has-sidebar`.
NOT_ITSELF = frozenset("has with no without show hide".split())
CLOSES = {
    "p": BLOCK - {"br", "body", "html", "caption", "dd", "dt", "legend", "li", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
}
#: Elements that an implied end tag does not reach through.
FENCES = frozenset("table td th button object html body ul ol dl div article section main".split())

#: Elements opened deeper than this become siblings, as in browsers.
DEPTH = 512

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "kids", "out", "named", "chars", "link_chars", "tags", "link_tags", "landmarks", "density", "total")

    def __init__(self, tag: str, out: bool = False, named: bool = False):
        self.tag, self.out, self.named = tag, out, named
        self.kids: list[Node | str] = []


def telling(tag: str, attributes: str) -> bool:
    """Whether a word of class or id tells that a block is no part of an article."""
    if not attributes or tag in ("html", "body", "main"):
        return False
    out = LEFT_OUT_ARTICLES if tag == "article" else LEFT_OUT_WORDS
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            words = [x.lower() for x in SPLIT.split(m[2] or m[3] or m[4] or "")]
            if any(w in out and (not i or words[i - 1] not in NOT_ITSELF) for i, w in enumerate(words)):
                return True
    return False


def unwanted(tag: str, attributes: str) -> bool:
    """Whether an element is no article by its kind or role, or hidden."""
    if tag in LEFT_OUT:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in LEFT_OUT_ROLES:
            return True
        if name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return " hidden" in f" {attributes.lower()} ".replace("=", " =") and bool(re.search(r"\shidden(?=[\s/=]|$)", f" {attributes.lower()}"))


def parse(page: str) -> Node:
    """The tree of a page under one root."""
    root = Node("html")
    stack = [root]
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        begin = m.start() if m else n
        if begin > at:
            stack[-1].kids.append(page[at:begin])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in BLOCK:
                    break
            continue
        if tag in ("html", "body") and len(stack) > 1 and tag == "html":
            continue
        for kind, ends in CLOSES.items():
            if tag in ends:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == kind:
                        del stack[i:]
                        break
                    if stack[i].tag in FENCES:
                        break
        node = Node(tag, unwanted(tag, m[3]), telling(tag, m[3]))
        stack[-1].kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?|</{re.escape(tag)}$", re.I).search(page, at)
            at = close.end() if close else n
        elif tag not in VOID and not m[3].endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    return root


def measure(root: Node) -> None:
    """chars, link_chars, tags, link_tags and landmarks of every node that stays, in post-order without recursion."""
    todo: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while todo:
        node, linked, done = todo.pop()
        linked = linked or node.tag == "a"
        if not done:
            todo.append((node, linked, True))
            todo += [(k, linked, False) for k in node.kids if not isinstance(k, str) and not k.out]
            continue
        node.chars = node.link_chars = node.tags = node.link_tags = 0
        node.landmarks = int(node.tag in LANDMARKS and not node.named)
        for k in node.kids:
            if isinstance(k, str):
                c = len("".join(html.unescape(k).split()))
                node.chars += c
                node.link_chars += c if linked else 0
            elif not k.out:
                node.chars += k.chars
                node.link_chars += k.link_chars
                node.tags += k.tags + (k.tag in NODES or k.tag == "a")
                node.link_tags += k.link_tags + (k.tag == "a")
                node.landmarks += k.landmarks


def weigh(scope: Node) -> None:
    """Density of every node below, and the density sum of the blocks right below it (inline elements are looked through)."""
    ratio = scope.link_chars / scope.chars if scope.chars else 0.0
    todo: list[tuple[Node, bool]] = [(scope, False)]
    while todo:
        node, done = todo.pop()
        if not done:
            todo.append((node, True))
            todo += [(k, False) for k in node.kids if not isinstance(k, str) and not k.out]
            continue
        node.density, node.total = density(node, ratio), 0.0
        for k in node.kids:
            if not isinstance(k, str) and not k.out:
                node.total += k.density if k.tag in NODES else k.total


def density(node: Node, ratio: float) -> float:
    """Characters a tag, less for links: the logarithm of the plain share, to a base that grows with the links."""
    c, lc, t, lt = node.chars, node.link_chars, max(1, node.tags), max(1, node.link_tags)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
    return c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(base + math.e)


def blocks_below(node: Node) -> list[Node]:
    """Blocks with text right below a node, in page order, looking through inline elements."""
    out, todo = [], [k for k in reversed(node.kids) if not isinstance(k, str)]
    while todo:
        x = todo.pop()
        if not x.out and x.chars:
            if x.tag in NODES:
                out.append(x)
            else:
                todo += [k for k in reversed(x.kids) if not isinstance(k, str)]
    return out


def densest(top: Node) -> list[Node]:
    """The path from top to the node with the largest density sum (the first of equals)."""
    above: dict[int, Node] = {}
    best, todo = top, [top]
    while todo:
        node = todo.pop()
        if node.total > best.total:
            best = node
        below = blocks_below(node)
        above.update((id(k), node) for k in below)
        todo += reversed(below)
    path = [best]
    while path[-1] is not top:
        path.append(above[id(path[-1])])
    return path[::-1]


def suspects(scope: Node) -> list[Node]:
    """Topmost blocks below with a telling name that are not the page's frame."""
    own = scope.chars - scope.link_chars
    out, todo = [], [k for k in reversed(scope.kids) if not isinstance(k, str)]
    while todo:
        node = todo.pop()
        if node.out:
            continue
        frame = (scope.landmarks and node.landmarks == scope.landmarks) or node.chars - node.link_chars > ESSENTIAL * own
        if node.named and not frame:
            out.append(node)
        else:
            todo += [k for k in reversed(node.kids) if not isinstance(k, str)]
    return out


def content(scope: Node) -> list[Node]:
    """The content subtrees, in page order: the densest one, branches beside its path that reach the path's least
    density, and headings beside it; no blocks with telling names."""
    weigh(scope)
    path = densest(scope)
    if left_out := suspects(scope):
        way = set(map(id, path))
        for node in left_out:
            node.out = True
        measure(scope)
        if not scope.chars:  # names would leave nothing
            for node in left_out:
                node.out = False
            measure(scope)
        weigh(scope)
        # a named block that density had chosen goes; the path is looked for anew
        path = densest(scope) if any(id(node) in way for node in left_out) or not path[-1].chars else path
    threshold = min(n.density for n in path)
    way, found = set(map(id, path[:-1])), []
    todo = [scope]
    while todo:
        node = todo.pop()
        if node is path[-1]:
            found.append(node)
        elif id(node) in way:
            todo += reversed(blocks_below(node))
        elif node.tag in HEADINGS:
            found.append(node)
        elif node.density >= threshold:
            found.append(densest(node)[-1])
    return found


def find(root: Node, tag: str) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == tag and node is not root:
            out.append(node)
            continue
        todo += [k for k in reversed(node.kids) if not isinstance(k, str) and not k.out]
    return out


def text_of(nodes: list[Node]) -> str:
    """Blocks of the nodes in page order, joined by one space."""
    blocks: list[list[str]] = [[]]
    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif not x.out:
            edge = x.tag in BLOCK
            if edge:
                blocks.append([])
                todo.append(None)
            todo += reversed(x.kids)
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return " ".join(t for t in texts if t)


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    bodies = find(root, "body")
    scope = bodies[0] if bodies else root
    measure(scope)
    return text_of(content(scope)) if scope.chars else ""


def main_text(pages: DataFrame, html_column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages with `text` and `n_chars`, its code points."""

    def work():
        def rows(found):
            texts = [extract(p) for p in found]
            return [texts, [len(t) for t in texts]]

        return rows

    return map_rows(pages, [html_column], T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]), work, keep)
