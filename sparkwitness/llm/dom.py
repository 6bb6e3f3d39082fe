"""A forgiving HTML tree: elements, their text, and the blocks that text forms."""

from __future__ import annotations

import html
import re
import sys

# Fixed values of the HTML standard, as far as block structure needs them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br button output meter progress ruby rt rp".split())
P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_SCOPE = frozenset("table ul ol dl article section div body html main aside nav header footer form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_COMMENT = re.compile(r"<!--.*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Element:
    """One element; ``parts`` holds its own texts (str) and child elements in page order."""

    __slots__ = ("tag", "attributes", "parent", "parts", "depth", "index")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag = tag
        self.attributes = attributes
        self.parent = parent
        self.parts: list[str | Element] = []
        self.depth = parent.depth + 1 if parent else 0
        self.index = 0

    def attribute_map(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attributes)} if self.attributes else {}


class _Open:
    """The open elements; the last open one of a tag is known without a walk, so that broken markup costs linear time."""

    def __init__(self, root: Element):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.scopes = [0]

    def push(self, node: Element) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in _SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def last(self, tag: str) -> int:
        """Place of the last open element of a tag; 0 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def close(self, place: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in _SCOPE:
                self.scopes.pop()


def parse(source: str) -> list[Element]:
    """All elements in page order, the root first; never fails on broken markup."""
    root = Element("#root", "", None)
    nodes, now, at = [root], _Open(root), 0
    end = source.rfind(">") + 1  # no tag ends behind it
    while True:
        m = _TOKEN.search(source, at, end) or _COMMENT.search(source, max(at, end))
        if m is None:
            break
        if m.start() > at:
            now.stack[-1].parts.append(source[at : m.start()])
        at = m.end()
        name = m[2] if m.re is _TOKEN else None
        if not name:
            if m[0].startswith("<!--") and not (len(m[0]) >= 7 and m[0].endswith("-->")):
                at = len(source)  # a comment that nothing ends
            continue
        tag = sys.intern(name.lower())
        if m[1]:
            if place := now.last(tag):
                now.close(place)
            continue
        if tag in P_ENDS and now.last("p") > now.scopes[-1]:
            now.close(now.last("p"))
        if tag in ENDS and (place := max(map(now.last, ENDS[tag]))) > now.scopes[-1]:
            now.close(place)
        child = Element(tag, m[3], now.stack[-1])
        child.index = len(nodes)
        nodes.append(child)
        now.stack[-1].parts.append(child)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            child.parts.append(source[at : close.start() if close else len(source)])
            at = close.end() if close else len(source)
        elif tag not in VOID and not (m[3].rstrip().endswith("/") and tag in INLINE):
            now.push(child)
    if at < len(source):
        now.stack[-1].parts.append(source[at:])
    return nodes


def clean(text: str) -> str:
    """Decode character references, make each run of white space one space, trim."""
    return " ".join(html.unescape(text).split())
