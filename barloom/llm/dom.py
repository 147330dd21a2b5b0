"""Pages as trees of block elements, their skeletons, and simple tree matching of two skeletons."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import groupby

#: Elements that begin a block of text; all others are part of the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary "
    "table tbody td template textarea tfoot th thead title tr ul".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of an article.
ASIDE = frozenset(
    "aside audio button canvas dialog footer form head header iframe menu nav noscript object script search select style svg template "
    "textarea title video".split())
#: Words in a class, id or role that name a part beside the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies dialog disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices pagination popup "
    "promo promotion recommended related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "widget widgets".split())
#: A name that begins so says something about another part ("has-sidebar").
ABOUT_OTHERS = frozenset("has no not with without".split())
#: An open element of the first kind ends where one of the second kind begins.
ENDS = {
    "p": BLOCKS - {"body", "html", "option", "optgroup"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"},
}
#: Elements below this depth count as part of the one above; their text stays.
DEPTH = 64

_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


class Node:
    """A block element; ``pieces`` holds its own text between child blocks as (block number, text)."""

    __slots__ = ("tag", "sign", "out", "children", "slot")

    def __init__(self, tag: str, sign: str, out: bool):
        self.tag, self.sign, self.out, self.slot = tag, sign, out, -1
        self.children: list[Node] = []


def _sign(tag: str, attrs: dict) -> str:
    """What must agree for two elements to match: tag and classes, numbers in them aside."""
    classes = sorted({_DIGITS.sub("#", re.sub(r"[()\s]", "", c)) for c in (attrs.get("class") or "").lower().split()})
    return ".".join([re.sub(r"[()\s]", "", tag), *classes])


def _beside(tag: str, attrs: dict) -> bool:
    """Whether an element is marked as beside the article; a page's large parts are judged by whole names only."""
    if tag in ASIDE or "hidden" in attrs:
        return True
    if tag in ("html", "body", "main") or not attrs:
        return False
    names = " ".join([attrs.get("class") or "", attrs.get("id") or "", attrs.get("role") or ""]).lower().split()
    if tag == "article":
        return not ASIDE_WORDS.isdisjoint(names)
    words = [w for name in names if (w := _WORD.findall(name)) and w[0] not in ABOUT_OTHERS]
    return any(not ASIDE_WORDS.isdisjoint(w) for w in words)


class Page(HTMLParser):
    """Reads a page into ``root`` and ``blocks``: (node, text, whether in an article, whether in main), in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#", "#", False)
        self.open: list[tuple[str, Node, bool, bool, bool]] = [("#", self.root, False, False, False)]     # tag, node, out, article, main
        self.blocks: list[tuple[Node, str, bool, bool]] = []
        self.text: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        _, node, out, article, main = self.open[-1]
        if text and not out:
            self.blocks.append((node, text, article, main))

    def _block(self) -> int:
        """The innermost open block element."""
        return next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] in BLOCKS), 0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag in VOID and tag != "hr":
            return
        named = dict(attrs)
        block = tag in BLOCKS
        if block:
            self.flush()
            while tag in ENDS.get(self.open[at := self._block()][0], ()):
                del self.open[at:]
        _, node, out, article, main = self.open[-1]
        beside = _beside(tag, named)
        if not block and not beside:
            return
        if not block:
            self.flush()
        if block and len(self.open) < DEPTH:
            child = Node(tag, _sign(tag, named), out or beside)
            node.children.append(child)
            node = child
        if tag != "hr":
            self.open.append((tag, node, out or beside, article or (tag == "article" and not out and not beside), main or tag == "main"))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)                              # a slash at the end means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        names = [t for t, *_ in self.open]
        if tag in names:
            self.flush()
            del self.open[len(names) - 1 - names[::-1].index(tag):]
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def read(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.close()
    page.flush()
    return page


def skeleton(root: Node) -> str:
    """The tree without text, neighbours with one sign taken as one repeated node; sets each element's ``slot``, its number in it.

    Where a node is repeated, its children are taken together by sign, so a long list is as small as its richest kind of item.
    """
    out: list[str] = []
    number = 0

    def walk(members: list[Node]) -> None:
        nonlocal number
        for m in members:
            m.slot = number
        number += 1
        out.append(members[0].sign)
        if len(members) == 1:
            groups = [list(g) for _, g in groupby(members[0].children, key=lambda c: c.sign)]
        else:
            kinds: dict[str, list[Node]] = {}
            for m in members:
                for c in m.children:
                    kinds.setdefault(c.sign, []).append(c)
            groups = list(kinds.values())
        if groups:
            out.append("(")
            for g in groups:
                walk(g)
            out.append(")")
        else:
            out.append(" ")

    walk([root])
    return "".join(out)


_PART = re.compile(r"([^() ]+)(\(| )|\)")


def tree(text: str) -> tuple[list[str], list[list[int]]]:
    """(signs, children) of a skeleton, by number."""
    signs: list[str] = []
    children: list[list[int]] = []
    above: list[int] = []
    for m in _PART.finditer(text):
        if m[0] == ")":
            above.pop()
            continue
        if above:
            children[above[-1]].append(len(signs))
        if m[2] == "(":
            above.append(len(signs))
        signs.append(m[1])
        children.append([])
    return signs, children


def simple_tree_matching(a: str, b: str) -> list[int]:
    """For each node of ``a`` the node of ``b`` it matches, or -1: the largest matching that keeps signs, parents and order."""
    signs_a, below_a = tree(a)
    signs_b, below_b = tree(b)
    tables: dict[tuple[int, int], list[list[int]]] = {}

    def size(i: int, j: int) -> int:
        """Nodes matched when i stands for j; the table of the children is kept for ``trace``."""
        if signs_a[i] != signs_b[j]:
            return 0
        xs, ys = below_a[i], below_b[j]
        m = [[0] * (len(ys) + 1)]
        for x in xs:
            row = [0]
            for k, y in enumerate(ys):
                best = max(row[k], m[-1][k + 1])
                if signs_a[x] == signs_b[y]:
                    best = max(best, m[-1][k] + size(x, y))
                row.append(best)
            m.append(row)
        tables[i, j] = m
        return m[-1][-1] + 1

    found = [-1] * len(signs_a)

    def trace(i: int, j: int) -> None:
        found[i] = j
        xs, ys, m = below_a[i], below_b[j], tables[i, j]
        x, y = len(xs), len(ys)
        while x and y:
            if m[x][y] == m[x - 1][y]:
                x -= 1
            elif m[x][y] == m[x][y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                trace(xs[x], ys[y])

    if signs_a and signs_b and size(0, 0):
        trace(0, 0)
    return found
