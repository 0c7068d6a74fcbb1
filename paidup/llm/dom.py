"""A small HTML reader: a tree that browsers would build from common pages, and its blocks of text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary"
    " table tbody td tfoot th thead tr ul".split()
)
#: A start tag closes an open element of these, up to an element that holds it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "option": ({"option"}, {"select", "datalist"}),
}

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "children", "slot")

    def __init__(self, tag: str, names: dict[str, str]):
        self.tag, self.names, self.slot = tag, names, None
        self.children: list[Node | str] = []

    @property
    def kind(self) -> str:
        """What makes nodes of two pages comparable."""
        return f"{self.tag}.{self.names.get('class', '')}" if self.names else self.tag


def parse(text: str) -> Node:
    root = Node("#root", {})
    stack, at, n = [root], 0, len(text)
    while at < n:
        token = _TOKEN.search(text, at)
        if token is None:
            stack[-1].children.append(text[at:])
            break
        if token.start() > at:
            stack[-1].children.append(text[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if token["end"]:
            if any(x.tag == tag for x in stack):
                while stack[-1].tag != tag:
                    stack.pop()
                stack.pop()
            continue
        rest = token["rest"]
        names = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _NAMES.finditer(rest)} if rest else {}
        if tag in BLOCKS:  # a block closes an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS:
                    break
        if tag in CLOSES:
            own, holds = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in own:
                    del stack[k:]
                    break
                if stack[k].tag in holds:
                    break
        node = Node(tag, names)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(text, at)
            node.children.append(text[at : end.start() if end else n])
            close = text.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else n
        elif tag not in VOID and not rest.endswith("/"):
            stack.append(node)
    return root


def blocks(node: Node, skipped) -> Iterator[tuple[Node, str]]:
    """(element, text) of every block in page order; ``skipped(element)`` leaves an element out whole."""
    parts: list[str] = []
    owner = node

    def flush() -> Iterator[tuple[Node, str]]:
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            yield owner, text

    todo: list = [(node, iter(node.children), True)]
    while todo:
        now, children, block = todo[-1]
        child = next(children, None)
        if child is None:
            todo.pop()
            if block:
                yield from flush()
                owner = next((x for x, _, b in reversed(todo) if b), node)
            continue
        if isinstance(child, str):
            parts.append(child)
        elif child.tag == "br" or child.tag == "hr":
            parts.append(" ")
        elif not skipped(child):
            if child.tag in BLOCKS:
                yield from flush()
                owner = child
            todo.append((child, iter(child.children), child.tag in BLOCKS))
