"""A small HTML tree and the selectors that listings need: tags, classes, ids, attributes, descendants, children."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]*))\s*)?\]|:(first-child)")


class Node:
    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    @property
    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text for c in self.children)

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def select(self, css: str) -> list[Node]:
        chains = [_chain(part) for part in css.split(",") if part.strip()]
        return [n for n in self.walk() if any(_ends(n, chain, self) for chain in chains)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES and self.at.tag in _CLOSES[tag]:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        up = self.at
        while up.parent and up.tag != tag:
            up = up.parent
        if up.parent:
            self.at = up.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _chain(css: str) -> list[tuple[str, list]]:
    """[(combinator, simple selectors)], from left to right."""
    out, how = [], " "
    for part in re.findall(r"\[[^\]]*\]|[^\s>\[]+(?:\[[^\]]*\][^\s>\[]*)*|>", css.strip()):
        if part == ">":
            how = ">"
            continue
        out.append((how, [m.groups() for m in _SIMPLE.finditer(part)]))
        how = " "
    return out


def _is(node: Node, simple: list) -> bool:
    for tag, cls, ident, attr, op, *values, pseudo in simple:
        have = node.attrs.get(attr.lower()) if attr else None
        want = next((v for v in values if v is not None), "")
        if tag and tag != "*" and node.tag != tag.lower():
            return False
        if cls and cls not in node.classes or ident and node.attrs.get("id") != ident:
            return False
        if pseudo and node.parent and next(c for c in node.parent.children if isinstance(c, Node)) is not node:
            return False
        if attr and (
            have is None or op == "=" and have != want or op == "*=" and want not in have or op == "^=" and not have.startswith(want)
            or op == "$=" and not have.endswith(want) or op == "~=" and want not in have.split() or op == "|=" and have != want and not have.startswith(want + "-")
        ):
            return False
    return bool(simple)


def _ends(node: Node, chain: list, top: Node) -> bool:
    if not chain or not _is(node, chain[-1][1]):
        return False
    if len(chain) == 1:
        return True
    up = node.parent
    while up is not None and up is not top.parent:
        if up.tag and _ends(up, chain[:-1], top):
            return True
        if chain[-1][0] == ">":
            return False
        up = up.parent
    return False


def read(scope: Node, selector: str | None) -> str | None:
    """`css@attr`: an attribute or the text of the first match, the scope itself where css is empty; null if blank."""
    if not selector:
        return None
    css, at, attr = selector.rpartition("@")
    if not at or (not css and not attr):
        css, attr = selector, ""
    css = css.strip()
    node = scope if not css else next(iter(scope.select(css)), None)
    if node is None:
        return None
    value = (node.attrs.get(attr.strip().lower()) if attr else node.text) or ""
    return value.strip() or None
