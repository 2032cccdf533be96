"""A small lenient document tree on the standard parser, with the few selectors that parsers need."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

# Elements without content, and those whose content is no visible text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript svg template".split())


class Node:
    """An element; `children` holds nodes and texts in order."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def get(self, name: str) -> str:
        return (self.attrs.get(name) or "").strip()

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def texts(self, hidden: bool = False) -> Iterator[tuple[Node, str]]:
        """(parent, text) of the texts below, in order; those of hidden elements only if asked for."""
        stack: list[tuple[Node, Node | str]] = [(self, c) for c in reversed(self.children)]
        while stack:
            parent, c = stack.pop()
            if isinstance(c, str):
                yield parent, c
            elif hidden or c.tag not in HIDDEN:
                stack += [(c, x) for x in reversed(c.children)]

    def text(self) -> str:
        """Visible text, pieces stripped and joined by blanks."""
        return " ".join(s for s in (" ".join(t.split()) for _, t in self.texts()) if s)

    def raw(self) -> str:
        return "".join(t for _, t in self.texts(hidden=True))

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n is not self and (not tags or n.tag in tags)]

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n is not self and n.tag in tags), None)

    def up(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def before(self) -> list[Node | str]:
        """Siblings ahead of this element, the nearest first."""
        if self.parent is None:
            return []
        at = next(i for i, c in enumerate(self.parent.children) if c is self)
        return self.parent.children[:at][::-1]

    def select(self, selector: str) -> list[Node]:
        """Elements that fit `tag`, `#id`, `.class`, `[attr]`, `[attr=x]`, `[attr^=x]`, `[attr*=x]`, alone or combined, and blanks for below."""
        found = [self]
        for step in selector.split():
            test = _compiled(step)
            found = list(dict.fromkeys(n for f in found for n in f.find_all() if test(n)))
        return found


_PART = re.compile(r"""^([a-zA-Z][\w-]*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([\^*$~]?=)["']?([^"'\]]*)["']?)?\]""")


def _compiled(step: str):
    tests = []
    for tag, ident, cls, attr, op, want in _PART.findall(step):
        if tag:
            tests.append(lambda n, t=tag.lower(): n.tag == t)
        elif ident:
            tests.append(lambda n, v=ident: n.get("id") == v)
        elif cls:
            tests.append(lambda n, v=cls: v in n.get("class").split())
        elif not op:
            tests.append(lambda n, a=attr: a in n.attrs)
        else:
            how = {"=": str.__eq__, "^=": str.startswith, "*=": str.__contains__, "$=": str.endswith, "~=": lambda s, v: v in s.split()}[op]
            tests.append(lambda n, a=attr, v=want, h=how: a in n.attrs and h(n.get(a), v))
    return lambda n: bool(tests) and all(t(n) for t in tests)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document")

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root
