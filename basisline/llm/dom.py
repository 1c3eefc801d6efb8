"""A small tolerant HTML tree: enough of the parsing rules for text densities and plain text."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

START = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
SPECIAL = re.compile(r"[>\"']")
NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")}
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes, and where the search for it stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_CLOSERS = BLOCKS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
SCOPES = frozenset("html body article section main div td th li table blockquote form aside nav header footer".split())


class Tokens:
    """The tags of a page in order, each place of the page read a bounded number of times, whatever is broken.

    A tag ends at the first `>` outside its quotes, or, if its quotes don't close before the end, at its first `>`; behind the
    last `>` of a page there are no tags. What a failed search for closing quotes has passed is remembered, and a later search
    that comes to one of these places outside quotes has failed too.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.open: set[int] = set()  # places of quotes from which no unquoted '>' follows

    def _end(self, pos: int) -> int:
        """Place of the `>` that ends a tag whose name ends at `pos`."""
        passed, at = [], pos
        while True:
            m = SPECIAL.search(self.html, at)
            k = m.start() if m else -1
            if m and m[0] == ">":
                return k
            close = self.html.find(m[0], k + 1) if m and k not in self.open else -1
            passed.append(k)
            if close < 0:
                self.open.update(passed)
                return self.html.find(">", pos)
            at = close + 1

    def after(self, pos: int) -> tuple[int, int, bool, str, str] | None:
        """The first tag from `pos` on: start, end, whether it closes, name in lower case ('' for comments and the like),
        attributes; None if there is no more."""
        while m := START.search(self.html, pos):
            if m[1]:
                end = self.html.find("-->", m.end())
                return m.start(), len(self.html) if end < 0 else end + 3, False, "", ""
            if m.end() > self.last:
                pos = self.html.find("<!--", m.start() + 1)  # only an open comment can still follow
                if pos < 0:
                    return None
                continue
            if m[3] is None:
                return m.start(), self.html.find(">", m.end()) + 1, False, "", ""
            end = self._end(m.end())
            return m.start(), end + 1, bool(m[2]), m[3].lower(), self.html[m.end() : end]
        return None


#: Every way a start tag closes an open one: the tags that are closed and where the search for them stops.
IMPLIED = [*dict.fromkeys((frozenset(w), frozenset(s)) for w, s in CLOSES.values()), (frozenset({"p"}), SCOPES), (frozenset({"head"}), frozenset({"html"}))]
CLOSED_BY = {t: IMPLIED.index((frozenset(w), frozenset(s))) for t, (w, s) in CLOSES.items()} | dict.fromkeys(P_CLOSERS - set(CLOSES), len(IMPLIED) - 2) | {"body": len(IMPLIED) - 1}
MARKS = frozenset().union(*[w | s for w, s in IMPLIED])


class Node:
    """An element: its tag, its class, id and role words, and its texts and children in page order.

    `near`: for every kind of implied end, is there an open element that such a tag would close?
    """

    __slots__ = ("items", "names", "near", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, names: str = ""):
        self.tag, self.parent, self.names, self.items = tag, parent, names, []
        near = parent.near if parent is not None else (False,) * len(IMPLIED)
        self.near = tuple(tag in w or (was and tag not in s) for was, (w, s) in zip(near, IMPLIED, strict=True)) if tag in MARKS else near


def parse(html: str) -> Node:
    """The tree under a root node 'html'; never fails. Raw text elements (scripts and the like) have no content.

    Open elements are counted by tag, so an end tag without one, or a start tag that closes nothing, costs no search: all
    searches together pass each element once, as they close what they pass.
    """
    root = at = Node("html", None)
    pos, tokens, depth = 0, Tokens(html), Counter()

    def closed(node: Node, tags: frozenset[str]) -> Node:
        while node.tag not in tags:
            depth[node.tag] -= 1
            node = node.parent
        depth[node.tag] -= 1
        return node.parent

    while True:
        t = tokens.after(pos)
        text = html[pos : t[0] if t else len(html)]
        if text:
            at.items.append(unescape(text) if "&" in text else text)
        if t is None:
            return root
        _, pos, ends, tag, attrs = t
        if ends:
            if depth[tag] > 0:
                at = closed(at, frozenset({tag}))
            continue
        if tag in ("", "html"):
            continue
        kind = CLOSED_BY.get(tag)
        if kind is not None and at.near[kind]:
            at = closed(at, IMPLIED[kind][0])
        names = " ".join(a or b or c for _, a, b, c in NAMES.findall(attrs)).lower() if "=" in attrs else ""
        node = Node(tag, at, names)
        at.items.append(node)
        if tag in RAW:
            end = RAW[tag].search(html, pos)
            pos = end.start() if end else len(html)
            at = node
            depth[tag] += 1
        elif tag not in VOID and not attrs.endswith("/"):
            at = node
            depth[tag] += 1


def blocks(node: Node, skip=lambda n: False) -> list[str]:
    """The node's texts by block, in page order: white space collapsed, empty blocks left out."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            flush()
        elif x is not node and (skip(x) or x.tag in RAW):
            continue
        else:
            if x.tag in BLOCKS:
                flush()
                todo.append(None)
            todo.extend(reversed(x.items))
    flush()
    return out


ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def attribute(attrs: str, name: str) -> str | None:
    """Value of a tag's first attribute of this name, references decoded; None if there is none with a value."""
    for m in ATTRIBUTE.finditer(attrs):
        if m[1].lower() == name and (value := next((x for x in m.groups()[1:] if x is not None), None)) is not None:
            return unescape(value)
    return None


def read_page(html: str) -> tuple[list[str], str | None, list[str]]:
    """One walk over a page, without building its tree: visible texts by block, title (None: none), targets of its links."""
    out: list[str] = []
    line: list[str] = []
    links: list[str] = []
    title = None
    pos, tokens = 0, Tokens(html)
    while True:
        t = tokens.after(pos)
        line.append(html[pos : t[0] if t else len(html)])
        tag = "p" if t is None else t[3]
        if tag in BLOCKS:
            text = "".join(line)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                out.append(text)
            line.clear()
        if t is None:
            return out, title, links
        _, pos, ends, tag, attrs = t
        if tag == "a" and not ends and (link := attribute(attrs, "href")) is not None:
            links.append(link)
        if tag in RAW and not ends:
            end = RAW[tag].search(html, pos)
            if tag == "title" and title is None and end:
                title = unescape(html[pos : end.start()])
            pos = end.start() if end else len(html)


def visible_text(html: str) -> list[str]:
    """All visible texts of a page by block."""
    return read_page(html)[0]
