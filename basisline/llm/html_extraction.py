"""Main text by composite text density.

Every element of the page tree gets its characters, tags, link characters and link tags. Its composite density is the
number of characters per tag, lowered where links carry the text (relative to the whole body). The density sum of an
element is the sum of its children's densities (its own loose text counts as a child). The element of the largest density
sum is the core of the page; the smallest density on its path up to the body is the threshold, and every block beside the
path that reaches it stays. Loose and inline texts of the path elements are blocks of their own; headings and blocks without
links stay when only such stand between them and text that stays. Where the core lies in an `article` or `main`, only
blocks of that element can stay, and there a block with few links may stay like one without.

Densities alone can't tell a long notice or reader comment from the article, so elements that HTML names as something else
(navigation, footers, asides, forms; classes, ids and roles such as "ad", "cookie" or "comments") leave the tree first,
unless they hold most of the page's paragraph text or all its articles. Names are read class by class: a name that only
tells what a wrapper has, lacks or does ("has-sidebar", "comments-open", "header-fixed") says nothing about its content.
If nothing is left although the body has text, the names are ignored, and then the forms too.

Edge cases: null and empty pages give an empty text; broken nesting, unclosed tags and pages of any length are parsed
whole; repeated rows are extracted each; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.llm.common import table
from basisline.llm.dom import BLOCKS, RAW, Node, blocks, parse

OTHER_TAGS = frozenset("head nav footer aside form button select datalist dialog menu object embed canvas svg audio video map input label".split()) | frozenset(RAW)
#: Parts of a class, id or role that name something else than the article, as its first or its last part.
OTHER_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login navbar navigation breadcrumb breadcrumbs pagination pager "
    "masthead topbar toolbar widget widgets related recommended recommendations trending share sharing social comment comments commentlist respond replies disqus complementary contentinfo copyright disclaimer".split()
)
#: Parts of the page's frame: they name an element only as the last part ("site-header", not "header-fixed").
FRAME_PARTS = frozenset("nav menu header footer sidebar aside rail search".split())
#: First and last parts of names that tell what a wrapper has, lacks or does.
MODIFIERS = frozenset("with without has no is not hide show".split())
STATES = frozenset("open opened closed close fixed sticky enabled disabled visible hidden active on off free page layout results".split())
#: Parts that make a header one of the article.
ARTICLE_PARTS = frozenset("article post entry story content".split())
#: Text of readers stays apart however long it is.
READERS = frozenset("comment comments commentlist respond replies disqus".split())

#: Elements that can be the core of a page; paragraphs, headings and inline elements are parts of one.
CONTAINERS = frozenset("html body main article section div td center blockquote details figure table tbody ul ol dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = re.compile(r"[-_]+")


def inside(node: Node) -> bool:
    """Does the element stand in an article or main?"""
    up = node.parent
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    return up is not None


def named(node: Node) -> set[str]:
    """The parts of its class, id and role that name the element as something else than article text."""
    found = set()
    for name in node.names.split():
        parts = [x for x in PARTS.split(name) if x]
        if not parts or parts[0] in MODIFIERS or len(parts) > 1 and parts[-1] in STATES:
            continue
        if parts[-1] == "header" and ARTICLE_PARTS & set(parts):
            continue
        found |= {x for x in (parts[0], parts[-1]) if x in OTHER_PARTS}
        if parts[-1] in FRAME_PARTS or parts[:2] == ["skip", "link"]:
            found.add(parts[-1])
    return found


def is_other(node: Node, names: bool = True) -> bool:
    """Is the element something else than article text, by its tag or (if asked for) its class, id or role?"""
    if node.tag in OTHER_TAGS:
        return True
    if node.tag in ("body", "html", "main", "article"):
        return False
    if node.tag == "header":
        return not inside(node)
    found = named(node) if names and node.names else set()
    return bool(found) and not (found == {"header"} and inside(node))


def holdings(root: Node) -> dict[Node, list[int]]:
    """Of each element: its characters in paragraphs outside links, and the articles and mains below it."""
    out: dict[Node, list[int]] = {}
    todo = [(root, False, False)]
    while todo:
        n, p, link = todo.pop()
        p, link = p or n.tag == "p", link or n.tag == "a"
        out[n] = [sum(len(x.strip()) for x in n.items if isinstance(x, str)) if p and not link else 0, 0]
        todo.extend((x, p, link) for x in n.items if isinstance(x, Node) and x.tag not in RAW)
    for n in reversed(out):
        if n is not root:
            up = out[n.parent]
            up[0], up[1] = up[0] + out[n][0], up[1] + out[n][1] + (n.tag in ("article", "main"))
    return out


def order(root: Node, names: bool = True, forms: bool = False) -> list[Node]:
    """The elements that may hold article text, parents before children.

    A form or an element of another name stays if it holds most of the page's paragraph text or all its articles.
    """
    out, todo, held = [], [root], None
    while todo:
        n = todo.pop()
        if n is not root and is_other(n, names) and not (forms and n.tag == "form"):
            if n.tag in OTHER_TAGS and n.tag != "form" or n.tag == "header" or named(n) & READERS:
                continue
            held = held or holdings(root)
            if 2 * held[n][0] <= held[root][0] and not 0 < held[n][1] == held[root][1]:
                continue
        out.append(n)
        todo.extend(x for x in reversed(n.items) if isinstance(x, Node))
    return out


def composite_density(c: list[int], body_links: float) -> float:
    """Characters per tag, scaled by a logarithm of how link-free the element is.

    c: characters, tags, link characters, link tags; zero counts count as one. The published base of the logarithm nears
    1 on pages without links; it is shifted by e - 1 so that it never does.
    """
    chars, tags, link_chars, link_tags = c
    if not chars:
        return 0.0
    tags = tags or 1
    free = chars / (link_chars or 1) * tags / (link_tags or 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_links * chars + math.e) + math.e - 1
    return chars / tags * max(math.log(free), 0.0) / math.log(base)


class Densities:
    """Counts, composite densities and density sums of the elements of a page, all by their place in `nodes`."""

    def __init__(self, nodes: list[Node]):
        self.place = {n: k for k, n in enumerate(nodes)}
        self.parent = [self.place.get(n.parent, -1) for n in nodes]
        self.count = [[0, 0, 0, 0] for _ in nodes]  # characters, tags, link characters, link tags
        loose = [0] * len(nodes)
        for k in range(len(nodes) - 1, -1, -1):
            n, c = nodes[k], self.count[k]
            loose[k] = sum(len(x.strip()) for x in n.items if isinstance(x, str))
            c[0] += loose[k]
            if n.tag == "a":
                c[2], c[3] = c[0], c[3] + 1
            if self.parent[k] >= 0:
                up = self.count[self.parent[k]]
                up[0], up[1], up[2], up[3] = up[0] + c[0], up[1] + c[1] + 1, up[2] + c[2], up[3] + c[3]
        self.body = next((k for k, n in enumerate(nodes) if n.tag == "body"), 0)
        links = self.count[self.body][2] / (self.count[self.body][0] or 1)
        self.dense = [composite_density(c, links) for c in self.count]
        self.total = [composite_density([x, 0, 0, 0], links) if x else 0.0 for x in loose]
        best = list(range(len(nodes)))  # of each subtree: the container of largest density sum
        for k in range(len(nodes) - 1, -1, -1):
            if nodes[k].tag in CONTAINERS and (best[k] == k or self.total[k] >= self.total[best[k]] or nodes[best[k]].tag not in CONTAINERS):
                best[k] = k
            p = self.parent[k]
            if p >= 0:
                self.total[p] += self.dense[k]
                b = best[k]
                if nodes[b].tag in CONTAINERS and (best[p] == p or self.total[b] > self.total[best[p]]):
                    best[p] = b
        self.core = best[self.body]


def main_text(html: str | None) -> str:
    """The article's blocks, one a line."""
    if not html:
        return ""
    root = parse(html)
    for names, forms in ((True, False), (False, False), (False, True)):
        if lines := article_lines(order(root, names, forms)):
            return "\n".join(lines)
    return ""


def article_lines(nodes: list[Node]) -> list[str]:
    """The blocks that the densities of these elements keep, in page order."""
    d = Densities(nodes)
    place, count = d.place, d.count
    other = lambda n: n not in place
    path, k = [d.core], d.core
    while k != d.body and d.parent[k] >= 0:
        k = d.parent[k]
        path.append(k)
    floor = min(d.dense[k] for k in path)
    scope = next((k for k in path if nodes[k].tag in ("article", "main") and count[k][0]), None)
    if scope is not None:
        path = path[: path.index(scope) + 1]
    above = set(path[1:])
    parts, todo = [], [nodes[path[-1]]]  # kept, may stay beside kept ones, is a heading, lines
    while todo:
        n = todo.pop()
        if isinstance(n, list):  # loose and inline texts of a path element, a block of their own
            run = Node("span", None)
            run.items = n
            links = sum(count[place[x]][2] for x in n if isinstance(x, Node))
            chars = sum(len(x.strip()) if isinstance(x, str) else count[place[x]][0] for x in n)
            if chars:
                parts.append((False, 2 * links < chars, False, blocks(run, other)))
            continue
        k = place[n]
        if k == d.core:
            parts.append((True, True, False, blocks(n, other)))
        elif k in above:
            todo.extend(reversed(grouped(n, place, {d.core} | above)))
        elif count[k][0]:
            heading = n.tag in HEADINGS
            few = not count[k][3] or scope is not None and 2 * count[k][2] < count[k][0]
            parts.append((d.dense[k] >= floor, heading or few, heading, blocks(n, other)))
    return beside(parts)


def grouped(node: Node, place: dict[Node, int], path: set[int]) -> list:
    """The node's blocks and path elements, and lists of the loose and inline texts between them, in page order."""
    out: list = []
    for x in node.items:
        if isinstance(x, Node) and x not in place:
            continue
        if isinstance(x, Node) and (x.tag in BLOCKS and x.tag != "br" or place[x] in path):
            out.append(x)
        elif out and isinstance(out[-1], list):
            out[-1].append(x)
        else:
            out.append([x])
    return out


def beside(parts: list[tuple[bool, bool, bool, list[str]]]) -> list[str]:
    """Lines of the kept parts and of those that may stay in one run with them; a heading needs a part after it."""
    out: list[str] = []
    run: list[tuple[bool, bool, bool, list[str]]] = []
    for part in [*parts, (False, False, False, [])]:
        if part[0] or part[1]:
            run.append(part)
            continue
        if any(x[0] for x in run):
            while run[-1][2] and not run[-1][0]:
                run.pop()
            out += [line for x in run for line in x[3]]
        run = []
    return out


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col(html)).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op5_composite_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
