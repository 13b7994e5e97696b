"""HTML pages as sequences of text blocks, for the main-text labeller.

A block is what stands between two block-level tags, without scripts, styles,
comments and other parts that are never shown. Each block knows the set of
tags and of class, id and role words on its path. Damaged markup is read as
browsers mostly do: missing end tags, stray end tags and open scripts at the
end of a page are no errors. One pass over the page, linear in its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

# Element classes of HTML.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup
    option p pre search section select summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript title textarea iframe noembed noframes svg math object audio video canvas".split())
TO_THE_END = frozenset(("script", "style", "title", "textarea", "iframe"))  # swallow the rest when they are not closed
# an element that opens closes these, unless one of the second stands between
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
          "option": (("option",), ("select",))}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:=\s*+"[^"<]*+"|=\s*+'[^'<]*+'|[^<>])*+)>|<[!?][^<>]*+>""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CLOSE = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}
NAME_WORD = re.compile(r"[a-z]+")


class Node:
    """An open element: its place in the tree and the words on its path."""
    __slots__ = ("tag", "path", "link", "known")

    def __init__(self, tag: str, path: frozenset, link: bool):
        self.tag, self.path, self.link = tag, path, link
        self.known: dict = {}

    def child(self, tag: str, attributes: str) -> Node:
        node = self.known.get((tag, attributes))
        if node is None:
            names = " ".join(x for m in NAMES.findall(attributes) for x in m) if "=" in attributes else ""
            words = {f".{w}" for w in NAME_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower())}
            if len(self.known) > 4096:
                self.known.clear()
            node = self.known[tag, attributes] = Node(tag, self.path | words | {tag}, self.link or tag == "a")
        return node


class Block:
    __slots__ = ("node", "text", "links")

    def __init__(self, node: Node, text: str, links: int):
        self.node, self.text, self.links = node, text, links


def page_blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order: character references decoded, white
    space as single spaces, none empty. A null page has none."""
    out: list[Block] = []
    page = page or ""
    stack, held = [Node("", frozenset(), False)], Counter()
    blocks = [0]  # places of the open block elements in the stack
    parts: list[str] = []
    links = 0
    owner = stack[0]  # innermost block element of the text held in parts
    at = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(owner, text, min(links, len(text))))
            parts.clear()
            links = 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            held[stack.pop().tag] -= 1
        while blocks[-1] >= depth:
            blocks.pop()

    for m in _tags(page):
        if m.start() > at:
            parts.append(page[at:m.start()])
            if stack[-1].link:
                links += m.start() - at
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCK
        if block:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m[1]:
            if held[tag] > 0:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                pop_to(depth)
        else:
            if block and stack[blocks[-1]].tag == "p":
                pop_to(blocks[-1])  # an open paragraph ends where another block begins
            if tag in CLOSES:
                ends, stops = CLOSES[tag]
                if any(held[e] for e in ends):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in stops:
                            break
                        if stack[i].tag in ends:
                            pop_to(i)
                            break
            if tag not in VOID and not m[3].endswith("/"):
                stack.append(stack[-1].child(tag, m[3]))
                held[tag] += 1
                if block:
                    blocks.append(len(stack) - 1)
        if block:
            owner = stack[blocks[-1]]
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def _tags(page: str) -> Iterator[re.Match]:
    """Tags and comments in order; a part that is never shown is passed over
    (its end tag closes nothing, as its start tag is not reported)."""
    at, gone = 0, set()
    while True:
        m = TAG.search(page, at)
        if m is None:
            return
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if tag in RAW and not m[1] and not m[3].endswith("/") and tag not in gone:
            end = CLOSE[tag].search(page, at)
            if end is not None:
                # reported as one tag whose text is skipped
                yield _Span(m.start(), end.end())
                at = end.end()
                continue
            if tag in TO_THE_END:
                yield _Span(m.start(), len(page))
                return
            gone.add(tag)
        yield m


class _Span:
    """A skipped stretch, as a match without a tag."""
    __slots__ = ("a", "b")

    def __init__(self, a: int, b: int):
        self.a, self.b = a, b

    def start(self) -> int:
        return self.a

    def end(self) -> int:
        return self.b

    def __getitem__(self, _: int) -> None:
        return None
