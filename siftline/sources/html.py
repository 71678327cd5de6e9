"""A tolerant HTML tree on the standard library's parser, with the selectors that sources use."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

#: Elements without content, and those whose text is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))


class Node:
    __slots__ = ("name", "attrs", "parent", "children")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []

    def elements(self) -> Iterator[Node]:
        """All elements below, in document order."""
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.elements()

    def _strings(self) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, str):
                yield child
            elif child.name not in HIDDEN:
                yield from child._strings()

    def text(self) -> str:
        """Stripped pieces of text joined by a space."""
        return " ".join(s for s in (x.strip() for x in self._strings()) if s)

    def siblings_after(self) -> list[Node]:
        if self.parent is None:
            return []
        peers = [c for c in self.parent.children if isinstance(c, Node)]
        return peers[peers.index(self) + 1 :]

    def select(self, selector: str) -> list[Node]:
        rules = [_parse(part) for part in _split(selector, ",")]
        return [n for n in self.elements() if any(_matches(n, rule) for rule in rules)]

    def select_one(self, selector: str) -> Node | None:
        return next(iter(self.select(selector)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        known: dict[str, str] = {}
        for name, value in attrs:
            known[name] = value or ""
        node = Node(tag, known, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None, entities: Sequence[str] | None = None) -> Node:
    """The tree of a page; unclosed elements end with their parents, stray end tags are ignored.

    Character references are resolved as browsers do, so also those that lack the semicolon; with entities, only these
    names, and only where closed by one.
    """
    html = html or ""
    if entities is not None:
        html = re.sub(rf"&(?!(?:{'|'.join(map(re.escape, entities))});)" if entities else "&", "&amp;", html)
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _split(selector: str, by: str) -> list[str]:
    """Parts outside brackets and quotes."""
    parts, depth, quote, now = [], 0, "", ""
    for c in selector:
        quote = "" if c == quote else quote or (c if c in "\"'" else "")
        depth += (c == "[") - (c == "]") if not quote else 0
        if c == by and not depth and not quote:
            parts.append(now)
            now = ""
        else:
            now += c
    return [p.strip() for p in [*parts, now] if p.strip()]


PIECE = re.compile(r"""\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?P<quote>["']?)(?P<value>.*?)(?P=quote))?\s*\]|(?P<tag>[a-zA-Z][\w-]*|\*)""")


def _parse(selector: str) -> list[tuple[bool, list[dict]]]:
    """(child of the one before, conditions) of each compound, outermost first."""
    out, child = [], False
    for token in _split(re.sub(r"\s*>\s*", " > ", selector), " "):
        if token == ">":
            child = True
            continue
        found, at = [], 0
        while at < len(token):
            m = PIECE.match(token, at)
            if not m:
                raise ValueError(f"selector not supported: {selector!r}")
            found.append(m.groupdict())
            at = m.end()
        out.append((child, found))
        child = False
    return out


def _fits(node: Node, conditions: list[dict]) -> bool:
    for c in conditions:
        if c["tag"] and c["tag"] != "*" and node.name != c["tag"].lower():
            return False
        if c["cls"] and c["cls"] not in node.attrs.get("class", "").split():
            return False
        if c["id"] and node.attrs.get("id") != c["id"]:
            return False
        if c["attr"]:
            have = node.attrs.get(c["attr"].lower())
            if have is None:
                return False
            op, want = c["op"], c["value"] or ""
            tests = {"=": have == want, "~=": want in have.split(), "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want), "*=": bool(want) and want in have}
            if op and not tests[op]:
                return False
    return True


def _matches(node: Node, rule: list[tuple[bool, list[dict]]]) -> bool:
    if not _fits(node, rule[-1][1]):
        return False
    if len(rule) == 1:
        return True
    above = node.parent
    while above is not None and above.name:
        if _matches(above, rule[:-1]):
            return True
        if rule[-1][0]:
            return False
        above = above.parent
    return False
