"""Main text of web pages by tree scoring.

Markup is parsed leniently into a tree.  Paragraphs pass points for their
length and commas to their parent and, halved, to their grandparent; a
container's points are discounted by its link density and shifted by telling
class names.  The best container is kept, with siblings that score like it or
read like prose.  What is boilerplate by its element or its name (menus,
headers of the page, footers, sidebars, notices, adverts, forms, comments) is
left out before scoring.  Character references are decoded; white space inside
a block becomes one space; blocks are joined by two line ends.

Markup is read as HTML does: end tags may be missing where they are optional.
An unwanted element whose end tag is required but missing is not left out, as
nobody knows where it ends; what it holds is scored like the rest.  A ``<``
that begins no whole tag is text.  Time and memory grow with the page's length
only, so a very long page is read whole.

Null and empty pages, and pages without text, give an empty text.  Rows are
independent, so repeated rows repeat results.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# Element names of the public HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SKIP = frozenset("nav footer aside form button select input label menu dialog head object embed canvas audio video map search".split()) | RAW
PARAGRAPH = frozenset("p pre td blockquote li dd".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag of these ends an open paragraph.
ENDS_P = BLOCK - frozenset("body html legend optgroup option td th tr tbody thead tfoot".split())
#: Open elements that a new sibling ends, and the elements that it doesn't look beyond.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements whose end tag is optional.
OPEN_END = frozenset("p li dt dd td th tr tbody thead tfoot option optgroup html body".split())

#: Names in class, id or role of what isn't the article.
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|comment-?list|disqus|respond|repl(?:y|ies)|reader-?\w*|discussion|cookie\w*|consent|gdpr|notice|notification|alert|"
    r"popup|modal|overlay|sidebar|side|aside|widget\w*|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|share|sharing|social|follow|subscribe|newsletter|signup|login|"
    r"footer|foot|masthead|site-?header|page-?header|topbar|toolbar|related|recommend\w*|more-?stories|trending|tags?|byline-?links|skip-?link|search|complementary|contentinfo|hidden|print-?only|toc)(?=$|[\s_-])",
    re.I,
)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|main-?content|post|entry|entry-?content|story|body|text|blog)(?=$|[\s_-])", re.I)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TAG = re.compile(r"</?([a-zA-Z][^\s/><]*)")
_ATTRIBUTES = re.compile(r"""(?:[^<>"']|"[^"]*"|'[^']*')*+""")
_LOOSE = re.compile(r"[^<>]*+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "score", "names", "bad", "chars", "linked", "commas")

    def __init__(self, tag: str, parent: "Node | None", names: str = "", bad: bool = False) -> None:
        self.tag, self.parent, self.children, self.score, self.names, self.bad = tag, parent, [], 0.0, names, bad
        self.chars = self.linked = self.commas = 0


def _unwanted(tag: str, attributes: str, names: str) -> bool:
    if tag in SKIP:
        return True
    if not attributes:
        return False
    for m in _NAMES.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return True
    return tag not in ("body", "html", "main", "article") and bool(_BAD.search(names)) and not _GOOD.search(names)


def _names(attributes: str) -> str:
    if not attributes:
        return ""
    return " ".join((m.group(2) or m.group(3) or m.group(4) or "") for m in _NAMES.finditer(attributes) if m.group(1).lower() in ("class", "id", "role"))


class Tree:
    """The open elements, outermost first; what is asked of them takes no search."""

    def __init__(self) -> None:
        self.root = Node("html", None)
        self.stack = [self.root]
        self.blocks: Counter = Counter()  # open block elements by tag
        self.inline: list[Counter] = [Counter()]  # open inline elements since each open block
        self.articles = 0

    @property
    def here(self) -> Node:
        return self.stack[-1]

    def open(self, node: Node) -> None:
        self.stack.append(node)
        if node.tag in BLOCK:
            self.blocks[node.tag] += 1
            self.inline.append(Counter())
            self.articles += node.tag in ("article", "main")
        else:
            self.inline[-1][node.tag] += 1

    def pop(self, ended: bool) -> Node:
        """Close the innermost; not ``ended`` if its own end tag is missing."""
        node = self.stack.pop()
        if node.tag in BLOCK:
            self.blocks[node.tag] -= 1
            self.inline.pop()
            self.articles -= node.tag in ("article", "main")
        else:
            self.inline[-1][node.tag] -= 1
        if not ended and node.tag not in OPEN_END:
            node.bad = False
        return node

    def close(self, tag: str) -> None:
        """An end tag; an inline one doesn't close blocks, and a stray one is dropped."""
        if not (self.blocks[tag] if tag in BLOCK else self.inline[-1][tag]):
            return
        while self.here.tag != tag:
            self.pop(False)
        self.pop(True)

    def make_room(self, tag: str) -> None:
        """End what a start tag ends: an open paragraph, an open sibling."""
        if tag in ENDS_P and self.blocks["p"]:
            k = len(self.stack) - 1 - sum(self.inline[-1].values())
            if self.stack[k].tag == "p":
                while len(self.stack) > k:
                    self.pop(False)
        if tag in SIBLINGS:
            family, border = SIBLINGS[tag]
            if any(self.blocks[x] for x in family):
                k = len(self.stack) - 1
                while k and self.stack[k].tag not in family and self.stack[k].tag not in border:
                    k -= 1
                if k and self.stack[k].tag in family:
                    while len(self.stack) > k:
                        self.pop(False)


def parse(html: str) -> Node:
    """A tree without unwanted parts.  Children are nodes or strings."""
    tree, at, size = Tree(), 0, len(html)
    unclosed: set[str] = set()  # raw elements without an end tag ahead
    attributes_at = _ATTRIBUTES
    seek = 0
    while True:
        start = html.find("<", seek)
        if start < 0:
            break
        seek = start + 1
        mark = html[start + 1 : start + 2]
        if mark in ("!", "?"):
            comment = html.startswith("<!--", start)
            end = html.find("-->" if comment else ">", start + (4 if comment else 2))
            if end < 0 and not comment:
                break  # no tag ends behind this place
            tree.here.children.append(html[at:start])
            at = seek = size if end < 0 else end + (3 if comment else 1)
            continue
        m = _TAG.match(html, start)
        if m is None:
            continue
        end = attributes_at.match(html, m.end()).end()
        if end < size and html[end] in "\"'":  # a quote that nothing closes: from here on quotes are characters
            attributes_at = _LOOSE
            end = attributes_at.match(html, m.end()).end()
        if end == size:
            break
        if html[end] == "<":
            continue
        if at < start:
            tree.here.children.append(html[at:start])
        at = seek = end + 1
        tag, attributes = m.group(1).lower(), html[m.end() : end]
        if mark == "/":
            if tag == "br":
                tree.here.children.append(Node("br", tree.here))
            else:
                tree.close(tag)
            continue
        if tag == "body":
            tree.close("head")
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                tree.here.children.append(Node(tag, tree.here))
            continue
        if tag in RAW:
            if tag not in unclosed:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                if stop is not None:
                    at = seek = stop.end()
                    continue
                unclosed.add(tag)
            if tag in ("script", "style"):
                at = size  # they have no text whatever follows
                break
            continue
        names = _names(attributes)
        tree.make_room(tag)
        bad = _unwanted(tag, attributes, names) or tag == "header" and not tree.articles
        node = Node(tag, tree.here, names, bad)
        tree.here.children.append(node)
        if not attributes.endswith("/") or tag in BLOCK and not bad:
            tree.open(node)
    if at < size:
        tree.here.children.append(html[at:])
    while len(tree.stack) > 1:
        tree.pop(False)
    return _pruned(tree.root)


def _pruned(root: Node) -> Node:
    """Unwanted nodes go; what stands before and after an unwanted block isn't one block."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c if isinstance(c, str) or not c.bad else Node("hr" if c.tag in BLOCK else "span", node) for c in node.children]
        stack += [c for c in node.children if not isinstance(c, str) and c.children]
    return root


def measure(root: Node) -> None:
    """Characters, characters in links and commas of every subtree, children first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if not isinstance(c, str)]
    for node in reversed(order):
        chars = linked = commas = 0
        for child in node.children:
            if isinstance(child, str):
                chars += len(child.strip())
                commas += child.count(",") + child.count("，") + child.count("、")
            else:
                chars, linked, commas = chars + child.chars, linked + child.linked, commas + child.commas
        node.chars, node.linked, node.commas = chars, chars if node.tag == "a" else linked, commas


def _own_text(node: Node) -> bool:
    return any(isinstance(c, str) and c.strip() for c in node.children)


def best_container(root: Node) -> Node:
    """The element with most points after the discount for links."""
    scored: dict[int, Node] = {}
    measure(root)
    stack = [root]
    while stack:
        node = stack.pop()
        stack += [c for c in node.children if not isinstance(c, str)]
        prose = node.tag in PARAGRAPH or node.tag in ("div", "section", "article", "main") and _own_text(node)
        if not prose:
            continue
        chars, linked, commas = node.chars, node.linked, node.commas
        if chars < 25 or linked > 0.5 * chars:
            continue
        points = 1 + commas + min(chars // 100, 3)
        own = node if node.tag not in PARAGRAPH or node.tag == "td" else node.parent
        for place, share in ((own, 1.0), (own.parent if own is not None else None, 0.5)):
            if place is None:
                continue
            if id(place) not in scored:
                scored[id(place)] = place
                place.score = (25.0 if place.tag in ("article", "main") else 0.0) + (25.0 if _GOOD.search(place.names) else 0.0) - (25.0 if _BAD.search(place.names) else 0.0)
            place.score += points * share
    best, top = root, -1.0
    for node in scored.values():
        node.score *= 1 - node.linked / max(1, node.chars)
        if node.score > top:
            best, top = node, node.score
    return best


def _kept(best: Node) -> list[Node]:
    """The best container with the siblings that belong to it."""
    if best.parent is None or best.tag in ("article", "main") and best.score > 0:
        return [best]
    limit, out = max(10.0, 0.2 * best.score), []
    for s in best.parent.children:
        if isinstance(s, str):
            continue
        if s is best or s.score >= limit:
            out.append(s)
        elif s.tag in HEADING or s.tag in PARAGRAPH or s.tag in ("div", "section"):
            chars, linked = s.chars, s.linked
            if s.tag in HEADING and s is not best or chars > 80 and linked < 0.25 * chars or 0 < chars <= 80 and not linked and s.tag == "p":
                out.append(s)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """The text of each block in page order."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            text = _SPACE.sub(" ", unescape("".join(run))).strip()
            run.clear()
            if text:
                out.append(text)

    for top in nodes:
        end()
        stack: list = [top]
        while stack:
            item = stack.pop()
            if item is None:
                end()
            elif isinstance(item, str):
                run.append(item)
            elif item.tag == "br":
                run.append(" ")
            elif item.tag in BLOCK:
                end()
                stack.append(None)
                stack += reversed(item.children)
            else:
                stack += reversed(item.children)
        end()
    return out


def main_text(html: str) -> str:
    """The article's text; empty if there is none."""
    if not html:
        return ""
    return "\n\n".join(blocks(_kept(best_container(parse(html)))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    rows = pages.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.coalesce(F.col(html_col).cast("string"), F.lit("")))

    def make():
        def work(rows):
            for key, url, html in rows:
                text = main_text(html)
                yield key, url, text, len(text)

        return work

    return map_rows(rows, make, "page_id long, url string, text string, n_chars long")
