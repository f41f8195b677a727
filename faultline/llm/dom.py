"""Pages as trees: a small tolerant HTML reader that gives elements, text leaves and the order of text.

Blocks are what stands between starts and ends of block elements. Inline elements without class, id or role are no nodes; links are
counted by the characters in them. A leaf is the text of one block directly inside one node. Character references are decoded. Text of
scripts, styles, templates, titles and form controls is left out. Missing end tags are supplied as browsers do for
paragraphs, list items, table parts and options; an end tag without start is ignored. Reading never fails, is not recursive and
takes time in proportion to the page.
"""

import html
import re
from typing import NamedTuple

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
DROPPED = frozenset(
    "script style template title noscript iframe noframes object applet audio video canvas svg math select textarea button datalist xmp".split()
)
RAW = frozenset("script style title iframe noframes textarea xmp".split())
#: Start tags that end an open element of the listed kinds, up to the first element of the second list.
_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_SKIP = re.compile(r"[\s/]*+")
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]*+))?""")
_NAMED = frozenset("class id role itemprop aria-label".split())
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[^\W\d_]+")
_SMALL = re.compile(r"[^\W\d_]+")


class Node(NamedTuple):
    parent: int
    tag: str  #: "#text" for leaves
    names: tuple[str, ...]  #: words of class, id, role, ... in lower case
    depth: int


class Run(NamedTuple):
    leaf: int
    block: int
    text: str
    link: bool


def words_of(value: str) -> list[str]:
    """Words of an attribute value in lower case: "postBody main-text" is post, body, main, text; and each name as one word."""
    found = []
    for name in value.split()[:20]:
        parts = [p.lower() for p in _PARTS.findall(name[:60])]
        found += parts
        if len(parts) > 1:
            found.append("".join(parts))
    return found


def _attributes(text: str, at: int) -> tuple[list[str], int]:
    """Words of the naming attributes of a tag, and the place behind its end (-1: the page ends in the tag)."""
    names: list[str] = []
    while True:
        at = _SKIP.match(text, at).end()
        if at >= len(text):
            return names, -1
        if text[at] == ">":
            return names, at + 1
        found = _ATTRIBUTE.match(text, at)
        at, value = found.end(), found[2]
        if value and value[0] in "\"'":
            if len(value) < 2 or value[-1] != value[0]:
                return names, -1
            value = value[1:-1]
        if value and found[1].lower() in _NAMED:
            names += words_of(html.unescape(value))


class Page:
    """``nodes`` in the order of the page, ``runs`` of text in order."""

    def __init__(self, text: str | None):
        self.nodes = [Node(-1, "#root", (), 0)]
        self.runs: list[Run] = []
        self._stack = [("#root", 0, False)]  # name, node (or the node around it), block element
        self._blocks, self._open = [0], {"#root": [0]}
        self._block, self._leaf, self._links = 0, -1, 0
        self._unclosed: set[str] = set()
        self._read(text or "")

    def _read(self, text: str) -> None:
        at, size = 0, len(text)
        while at < size:
            mark = text.find("<", at)
            if mark < 0:
                mark = size
            if mark > at:
                self._data(text[at:mark])
            if mark >= size:
                return
            after = text[mark + 1 : mark + 2]
            if after.isascii() and after.isalpha():
                name = _NAME.match(text, mark + 1)
                names, at = _attributes(text, name.end())
                if at < 0:
                    return
                at = self._start(text, name[0].lower(), names, at)
                if at < 0:
                    return
            elif after == "/" and _NAME.match(text, mark + 2):
                name = _NAME.match(text, mark + 2)
                _, at = _attributes(text, name.end())
                if at < 0:
                    return
                self._end(name[0].lower())
            elif text.startswith("<!--", mark):
                if text.startswith("<!-->", mark) or text.startswith("<!--->", mark):
                    at = text.index(">", mark) + 1
                else:
                    end = text.find("-->", mark + 4)
                    at = size if end < 0 else end + 3
            elif after and after in "!?/":
                end = text.find(">", mark)
                at = size if end < 0 else end + 1
            else:
                self._data("<")
                at = mark + 1

    def _data(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        around = self._stack[-1][1]
        if self._leaf < 0 or self.nodes[self._leaf].parent != around or self.runs[-1].block != self._block:
            if not text.strip():
                if self._leaf >= 0:
                    self.runs.append(Run(self._leaf, self._block, " ", False))
                return
            self._leaf = len(self.nodes)
            self.nodes.append(Node(around, "#text", (), self.nodes[around].depth + 1))
        self.runs.append(Run(self._leaf, self._block, text, self._links > 0))

    def _cut(self) -> None:
        self._block += 1
        self._leaf = -1

    def _push(self, name: str, node: int, block: bool) -> None:
        self._open.setdefault(name, []).append(len(self._stack))
        if block:
            self._blocks.append(len(self._stack))
        self._stack.append((name, node, block))
        self._links += name == "a"

    def _pop_to(self, place: int) -> None:
        while len(self._stack) > place:
            name, _, block = self._stack.pop()
            self._open[name].pop()
            self._links -= name == "a"
            if block:
                self._blocks.pop()
                self._cut()

    def _node(self, name: str, names: list[str]) -> int:
        around = self._stack[-1][1]
        self.nodes.append(Node(around, name, tuple(names), self.nodes[around].depth + 1))
        return len(self.nodes) - 1

    def _start(self, text: str, name: str, names: list[str], at: int) -> int:
        if name in DROPPED:
            end = -1 if name in self._unclosed else _behind(text, name, at)
            if end < 0 and name not in RAW:
                self._unclosed.add(name)
                return at
            return end
        if name in VOID:
            if name == "hr":
                self._cut()
            elif name == "br":
                self._data(" ")
            return at
        if name in INLINE or "-" in name:
            if name == "a" and self._open.get("a") and self._open["a"][-1] > self._blocks[-1]:
                self._pop_to(self._open["a"][-1])
            node = self._node(name, names) if names else self._stack[-1][1]
            self._push(name, node, False)
            return at
        if self._stack[self._blocks[-1]][0] == "p":
            self._pop_to(self._blocks[-1])
        ended, up_to = _ENDS.get(name, ((), ()))
        if self._open.get("head") and name not in ("html", "head"):
            self._pop_to(self._open["head"][-1])
        while ended:
            near = max((self._open[x][-1] for x in ended if self._open.get(x)), default=0)
            wall = max((self._open[x][-1] for x in up_to if self._open.get(x)), default=0)
            if near <= wall or not near:
                break
            self._pop_to(near)
        self._cut()
        self._push(name, self._node(name, names), True)
        return at

    def _end(self, name: str) -> None:
        found = self._open.get(name)
        if not found or name in ("body", "html"):
            return
        if found[-1] > self._blocks[-1] or self._stack[found[-1]][2]:
            self._pop_to(found[-1])


def _behind(text: str, name: str, at: int) -> int:
    """The place behind a left-out element; -1 where it has no end."""
    depth, tag = 1, re.compile(rf"<(/?){name}(?=[\s/>]|\Z)", re.IGNORECASE)
    while depth:
        found = tag.search(text, at)
        if not found:
            return -1
        depth += -1 if found[1] else 0 if name in RAW else 1
        _, at = _attributes(text, found.end())
        if at < 0:
            return -1
    return at
