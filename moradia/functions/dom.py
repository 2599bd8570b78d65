"""A small tolerant tree of a page over the standard parser, for what needs structure: cards, breadcrumbs, menus, learned selectors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset(("br", "img", "meta", "link", "input", "hr", "source", "wbr", "area", "base", "col", "embed", "param", "track"))
#: A start tag closes an open element of these.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """The elements below, in order of the page."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def find(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def find_all(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if test(n)]

    def text(self, skipped: frozenset[str] = frozenset()) -> str:
        """The text below, joined as it stands, without the elements of ``skipped``."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in skipped or n is self:
                stack += reversed(n.children)
        return "".join(out)

    def words(self, skipped: frozenset[str] = frozenset()) -> str:
        """The text below with one space between pieces."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in skipped or n is self:
                stack += reversed(n.children)
        return " ".join(" ".join(out).split())

    def up(self, test: Callable[[Node], bool]) -> Node | None:
        n: Node | None = self
        while n is not None and not test(n):
            n = n.parent
        return n


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.at.tag in CLOSES.get(tag, ()):
            self.at = self.at.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        n = self.at.up(lambda x: x.tag == tag)
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(page: str) -> Node:
    """The tree of a page; unclosed and stray tags do no harm."""
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root


def matcher(selector: str) -> Callable[[Node], bool]:
    """A test of elements for a list of simple selectors: ``tag``, ``.class``, ``[attr]``, ``[attr*='part']`` and joins of these."""
    tests = []
    for one in selector.split(","):
        m = re.fullmatch(r"\s*([a-z0-9]*)((?:\.[\w-]+)*)((?:\[[^\]]+\])*)\s*", one)
        if not m:
            raise ValueError(f"not a simple selector: {one}")
        classes = [c for c in m[2].split(".") if c]
        attrs = [re.fullmatch(r"([\w-]+)(?:(\*?=)[\"']?([^\"']*)[\"']?)?", a).groups() for a in re.findall(r"\[([^\]]+)\]", m[3])]
        tests.append((m[1], classes, attrs))

    def test(n: Node) -> bool:
        for tag, classes, attrs in tests:
            if tag and n.tag != tag:
                continue
            if classes and not set(classes) <= set(n.attrs.get("class", "").split()):
                continue
            if all(k in n.attrs and (op is None or (v in n.attrs[k] if op == "*=" else n.attrs[k] == v)) for k, op, v in attrs):
                return True
        return False

    return test
