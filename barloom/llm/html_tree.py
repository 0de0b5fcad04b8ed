"""Small lenient HTML trees: enough structure to align pages and to read their text in blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead tr ul caption".split()
)
# An opening tag of these ends an open paragraph, or an open one of its own kind.
_ENDS_P = BLOCK - {"br", "body", "html", "option"}
_ENDS_OWN = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
_KEEPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_TAG = re.compile(
    r"<(?:!--(?:.*?-->|.*)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)|[!?][^>]*+>)", re.DOTALL
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)


class Node:
    __slots__ = ("children", "names", "tag")

    def __init__(self, tag: str, names: str = "") -> None:
        self.tag, self.names = tag, names
        self.children: list[Node | str] = []

    @property
    def label(self) -> str:
        """What aligned nodes must share."""
        return f"{self.tag}.{self.names}" if self.names else self.tag

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


def parse(html: str) -> Node:
    """The tree of a page. Unclosed elements end with their parent, stray end tags are ignored."""
    root = Node("#page")
    stack = [root]
    at = 0
    found = _TAG.search(html)
    while found:
        if found.start() > at:
            stack[-1].children.append(html[at : found.start()])
        at = found.end()
        name = found.group(2)
        if name:
            tag = name.lower()
            if found.group(1):
                _close(stack, tag)
            else:
                _open(stack, tag, found.group(3))
                if tag in RAW and not found.group(3).endswith("/>"):
                    end = re.compile(rf"</{re.escape(tag)}[^>]*>|\Z", re.IGNORECASE).search(html, at)
                    at = end.end()
                    stack.pop()
        found = _TAG.search(html, at)
    if at < len(html):
        stack[-1].children.append(html[at:])
    return root


def _close(stack: list[Node], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return


def _open(stack: list[Node], tag: str, rest: str) -> None:
    if tag in _ENDS_P:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                del stack[k:]
                break
            if stack[k].tag in BLOCK or stack[k].tag in ("button", "object"):
                break
    for k in range(len(stack) - 1, 0, -1) if tag in _ENDS_OWN else ():
        if stack[k].tag in _KEEPS[tag]:
            break
        if stack[k].tag in _ENDS_OWN[tag]:
            del stack[k:]
            break
    names = ""
    if len(rest) > 1:
        names = " ".join(sorted({x for m in _NAMED.finditer(rest) for x in (m[1] or m[2] or m[3] or "").lower().split()}))
    node = Node(tag, names)
    stack[-1].children.append(node)
    if tag not in VOID:
        stack.append(node)


def walk(root: Node) -> Iterator[tuple[Node, str]]:
    """All elements in page order, each with the labels from the top down to it."""
    stack = [(root, "")]
    while stack:
        node, path = stack.pop()
        yield node, path
        stack += [(c, f"{path}/{c.label}") for c in reversed(node.elements())]


def blocks(root: Node, dropped) -> list[str]:
    """Texts between block boundaries below ``root``, without subtrees for which ``dropped(node)`` holds."""
    out: list[str] = []
    own: list[str] = []

    def end() -> None:
        if own:
            text = " ".join(unescape("".join(own)).split())
            if text:
                out.append(text)
            own.clear()

    stack: list = [root]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            own.append(item)
        elif item is root or not dropped(item):
            if item.tag in BLOCK:
                end()
                stack.append(None)
            stack += reversed(item.children)
    end()
    return out
