"""A web page as a tree of block elements with their text, ready for extraction."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from html import unescape

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|data-y)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")

# fixed values: element names of the HTML standard
SKIPPED = frozenset("script style noscript template title iframe textarea svg math object canvas select audio video xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Elements that one of the same kind ends when it begins, and the elements that this doesn't reach beyond.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table td th body div section article main aside".split())


@dataclass
class Page:
    """Blocks in order of their start; the first is the page itself.

    ``pieces`` has (block, text) for every run of text that no block's start
    or end interrupts, in page order, white space joined.
    """

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["body"])
    names: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])
    label: list[int | None] = field(default_factory=lambda: [None])
    linked: list[int] = field(default_factory=lambda: [0])
    pieces: list[tuple[int, str]] = field(default_factory=list)


def parse(html: str, labels: bool = True) -> Page:
    """The page's tree; any text parses, also an empty one or one without tags.

    Without ``labels``, as for pages that nobody has labelled, ``data-y`` is an
    attribute like any other and may have any value.
    """
    page, stack, links = Page(), [("body", 0)], 0
    places: dict[str, list[int]] = defaultdict(list)  # of each tag's open elements in the stack, so that nothing scans it
    run: list[str] = []

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                page.pieces.append((stack_block(), text))
            run.clear()

    def stack_block() -> int:
        return stack[-1][1]

    def add(raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        run.append(text)
        if links:
            page.linked[stack_block()] += len(text)

    def push(tag: str, block: int) -> None:
        places[tag].append(len(stack))
        stack.append((tag, block))

    def pop_to(i: int) -> None:
        nonlocal links
        if any(tag not in INLINE for tag, _ in stack[i:]):
            flush()
        for tag, _ in stack[i:]:
            places[tag].pop()
            links -= tag == "a"
        del stack[i:]

    def last(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if t in places and places[t]), default=0)

    def end_open(tags: tuple[str, ...], scopes: frozenset[str]) -> None:
        i = last(tags)
        if i and i >= last(scopes):
            pop_to(i)

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if i := last((tag,)):
                pop_to(i)
            continue
        if tag in SKIPPED:
            # only drawings and formulas can be closed by their start tag
            if not (m[3].endswith("/") and tag in ("svg", "math")):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else n
            continue
        if tag in ("html", "head", "body"):
            continue
        if tag in VOID:
            if tag not in INLINE:
                if tag == "hr":
                    end_open(("p",), _SCOPES)
                flush()
            elif tag == "br":
                run.append(" ")
            continue
        if tag in _CLOSES_P:
            end_open(("p",), _SCOPES)
        if tag in _SIBLINGS:
            end_open(_SIBLINGS[tag], frozenset(("ul", "ol", "dl", "table")))
        if tag in INLINE:
            push(tag, stack_block())
            links += tag == "a"
            continue
        flush()
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[3])} if "=" in m[3] else {}
        label = found.pop("data-y", None)
        up = stack_block()
        page.parent.append(up)
        page.tag.append(tag)
        page.names.append(frozenset(_NAME.findall(" ".join(found.values()).lower())))
        page.label.append(int(label) if labels and label is not None else page.label[up])
        page.linked.append(0)
        push(tag, len(page.tag) - 1)
    if at < n:
        add(html[at:])
    flush()
    return page
