"""A small HTML tree with CSS selection on the standard library's parser, for use inside Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_STEP = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([*^$]?=)[\"']?([^\"'\]]*)[\"']?)?\]")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """The elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self, without: frozenset[str] = frozenset()) -> Iterator[str]:
        stack: list = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in without:
                stack.extend(reversed(x.children))

    def text(self, sep: str = "", strip: bool = False, without: frozenset[str] = frozenset()) -> str:
        parts = self.strings(without)
        return sep.join([s for s in (p.strip() for p in parts) if s] if strip else parts)

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def select(self, css: str) -> list[Node]:
        chains = _compiled(css)
        return [n for n in self.walk() if any(_matches(n, chain, self) for chain in chains)]

    def first(self, css: str) -> Node | None:
        chains = _compiled(css)
        return next((n for n in self.walk() if any(_matches(n, chain, self) for chain in chains)), None)


@cache
def _compiled(css: str) -> tuple:
    """For each of the alternatives, its steps from the last to the first: (tests, whether the step before is the parent)."""
    out = []
    for part in css.split(","):
        steps, direct = [], False
        for token in re.sub(r"\s*>\s*", " > ", part.strip()).split():
            if token == ">":
                direct = True
                continue
            steps.append((tuple(_STEP.findall(token)), direct))
            direct = False
        out.append(tuple(reversed(steps)))
    return tuple(out)


def _passes(node: Node, tests: tuple) -> bool:
    for tag, ident, cls, attr, op, value in tests:
        if tag and tag != "*" and node.tag != tag.lower():
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if attr:
            own = node.attrs.get(attr)
            if own is None or (op == "=" and own != value) or (op == "*=" and value not in own) or (op == "^=" and not own.startswith(value)) or (op == "$=" and not own.endswith(value)):
                return False
    return True


def _matches(node: Node, chain: tuple, root: Node, at: int = 0) -> bool:
    tests, direct = chain[at]
    if not _passes(node, tests):
        return False
    if at + 1 == len(chain):
        return not direct or node.parent is root
    up = node.parent
    while up is not None:
        if _matches(up, chain, root, at + 1):
            return True
        up = None if direct else up.parent
    return False


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
