"""Main text of web pages by tag-path ratios.

A page becomes text blocks in page order, each with its tag path from the root. Per path, text
length, punctuation and link text are summed over its blocks. Two ratios follow, text per block
and punctuation per block; both are smoothed over neighbouring blocks of the page, so that a short
paragraph among long ones is not lost and a long notice among menus is not gained, then fused with
their own value, so that a short line beside long ones gains little, and the share of text outside
links. Where article or main elements hold most of the page's text, paths outside of them weigh less.
Paths whose fused ratio reaches a part of the page's best are content, and with them the headings,
lists, tables, quotes and code of the elements that hold them, and all that lies between two content
blocks of one element, unless made of links. Blocks in
containers that are menus, headers, footers, sidebars or hidden by tag, role or attribute never take
part. Forms, and what a class or id calls an advert, a notice, a comment or the like, are paths of
their own that weigh far less, and nothing beside a sentence that stands outside of them. Neither counts
for wrappers: an element around most of what is in the page's articles, or, in an article or on a page
without one, an element around most of the text that leaves no sentence outside.

Pages are handled one by one in tasks; there is no shuffle.

Defined cases: a null or empty html gives an empty text; broken markup (open tags, cut-off pages,
quotes that never close) is read as far as it goes; an empty table gives an empty result; columns
of any name pass through.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Part of the best fused ratio that a path must reach.
THRESHOLD = 0.4
# Weights of a block and of the blocks one and two places away.
KERNEL = (0.4, 0.2, 0.1)
# Weight of a path outside the article, where that holds most of the text.
OUTSIDE = 0.5
# Weight of a path whose form or name speaks against it.
NAMED = 0.1
# Characters of an element that can count as most of a page's text, whatever its name.
MOST_CHARS = 200
# Characters of the shortest sentence.
SENTENCE = 12
# A list or another text element with this share of its text in links is a menu.
LINKS = 0.7

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript select button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNWANTED = frozenset("head nav footer aside menu dialog svg math object audio video canvas map".split())
FORMS = frozenset(("form", "fieldset"))
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Elements that belong to the text of the container around them.
TEXT = HEADINGS | frozenset(
    "p ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption details "
    "summary header hgroup address center".split())
UNWANTED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
UNWANTED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription signup login sidebar sidenav nav navbar navigation menu breadcrumb "
    "breadcrumbs pagination pager footer foot masthead comment comments commentlist disqus reply "
    "replies respond related recommended share sharing social widget toolbar skip".split())
HEADER_NAMES = frozenset(("header", "topbar", "head"))
# Before an unwanted name, these tell of a page's layout or of what a text is about.
LAYOUT_NAMES = frozenset("has have no not with without category tag topic hide hides".split())
#: Start tags that end an open element of these kinds.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"),
}
_FENCES = frozenset("ul ol dl table article main section div body blockquote td th nav aside footer header".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOP = re.compile(r"[.!?…。！？؟]")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟،]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I) for t in RAW}


@dataclass(slots=True, eq=False)
class Node:
    """An open element. ``low`` and ``high`` are the places of the first and last content block in it."""

    tag: str
    unwanted: bool = False
    article: bool = False
    parent: "Node | None" = None
    named: bool = False
    chars: int = 0
    article_chars: int = 0
    #: There is an article or main element in it.
    around: bool = False
    low: int = -1
    high: int = -1
    #: The same for those content blocks whose container it is.
    first: int = -1
    last: int = -1

    def container(self) -> tuple["Node", "Node"]:
        """The container whose text this element belongs to, and the outermost text element below it."""
        node = outer = self
        while node.parent and (node.tag in TEXT or node.tag in INLINE):
            if node.tag in TEXT:
                outer = node
            node = node.parent
        return node, outer


@dataclass(slots=True)
class Block:
    path: str
    text: str
    links: int
    in_article: bool
    heading: bool
    node: Node
    named: bool = False

    def sentence(self) -> bool:
        """Whether it reads like text, not like a label or a link."""
        n = len(self.text)
        return (not self.heading and n >= SENTENCE and 2 * self.links < n
                and (n >= 8 * SENTENCE or _STOP.search(self.text) is not None))


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in UNWANTED or (tag == "header" and not in_article):
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in UNWANTED_ROLES:
            return True
        if (name == "hidden" and not value) or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _named(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether the name, the role or the form speaks against an element."""
    if tag in FORMS:
        return True
    if not attributes or "=" not in attributes or tag in ARTICLE or tag in ("html", "body"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() == "form":
            return True
        if name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _NAME.findall(one)]
                for k, w in enumerate(words):
                    if w in UNWANTED_NAMES or (not in_article and w in HEADER_NAMES):
                        if not LAYOUT_NAMES.intersection(words[:k]):
                            return True
    return False


def text_blocks(html: str) -> list[Block]:
    """The blocks outside unwanted containers, in page order."""
    blocks: list[Block] = []
    #: Texts of named elements within a line, by the number of the block.
    pieces: dict[int, list[tuple[str, int, Node | None]]] = {}
    held_pieces: list[tuple[str, int, Node | None]] = []
    stack: list[Node] = []
    held: list[str] = []
    root = node = Node("")
    path, links, in_link, hidden, in_article, named_lines = "", 0, 0, 0, 0, 0
    any_named = has_article = False

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            if text:
                if any(p[2] for p in held_pieces):
                    pieces[len(blocks)] = held_pieces[:]
                blocks.append(Block(path, text, min(links, len(text)), in_article > 0,
                                    any(o.tag in HEADINGS for o in stack), node))
            held.clear()
        held_pieces.clear()
        links = 0

    def pop() -> None:
        nonlocal hidden, in_article, in_link, named_lines
        last = stack.pop()
        named_lines -= last.named and last.tag in INLINE
        hidden -= last.unwanted
        in_article -= last.article
        in_link -= last.tag == "a"

    def add(text: str) -> None:
        nonlocal links
        if hidden or not text:
            return
        if "&" in text:
            text = _html.unescape(text)
        if named_lines and not held_pieces:
            held_pieces.append(("".join(held), links, None))
        held.append(text)
        linked = len(text.strip()) if in_link else 0
        links += linked
        if held_pieces:
            within = None
            for o in reversed(stack):
                if o.tag not in INLINE:
                    break
                if o.named:
                    within = o
            held_pieces.append((text, linked, within))

    at, end = 0, len(html)
    while at < end:
        found = _TAG.search(html, at)
        if not found:
            add(html[at:])
            break
        add(html[at:found.start()])
        at = found.end()
        closing = found[1] if found[2] else found[4]
        tag = (found[2] or found[5] or "").lower()
        attributes = found[3] if found[2] else found[6] or ""
        if not tag:
            continue
        if tag in INLINE:
            if tag in VOID:
                held.append(" " if tag in ("br", "wbr") and not hidden and tag == "br" else "")
                if held_pieces:
                    held_pieces.append((held[-1], 0, None))
            elif closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i].tag not in INLINE:
                        break
            elif not attributes.endswith("/"):
                bad = _unwanted(tag, attributes, in_article > 0)
                named = _named(tag, attributes, in_article > 0)
                stack.append(Node(tag, bad, False, stack[-1] if stack else root, named))
                hidden += bad
                named_lines += named
                any_named |= named
                in_link += tag == "a"
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        pop()
                    break
        elif tag in RAW:
            at = _RAW_END[tag].search(html, at).end()
        elif tag not in VOID:
            # A block inside an open paragraph ends it, and some elements end their like.
            ends = (*_ENDS.get(tag, ()), "p")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ends:
                    while len(stack) > i:
                        pop()
                elif stack[i].tag in _FENCES and stack[i].tag not in ends:
                    break
            if not attributes.endswith("/"):
                bad = _unwanted(tag, attributes, in_article > 0)
                named = _named(tag, attributes, in_article > 0)
                stack.append(Node(tag, bad, tag in ARTICLE, stack[-1] if stack else root, named))
                hidden += bad
                any_named |= named
                if tag in ARTICLE and not hidden:
                    has_article = True
                    for o in stack[:-1]:
                        o.around = True
                in_article += tag in ARTICLE
        path = "/".join(o.tag for o in stack if o.tag not in INLINE)
        node = next((o for o in reversed(stack) if o.tag not in INLINE), root)
    flush()
    return _weighed_names(blocks, pieces, root, has_article) if any_named else blocks


def _weighed_names(blocks: list[Block], pieces: dict[int, list[tuple[str, int, Node | None]]], root: Node,
                   has_article: bool) -> list[Block]:
    """Marks the blocks of named elements, unless these are wrappers, and gives them paths of their own.
    Texts of named elements within a line become blocks behind it."""

    def counted(node: Node | None, chars: int, in_article: bool) -> None:
        while node:
            node.chars += chars
            node.article_chars += chars * in_article
            node = node.parent

    for i, b in enumerate(blocks):
        if i in pieces:
            for text, _, within in pieces[i]:
                counted(within or b.node, len(text.strip()), b.in_article)
        else:
            counted(b.node, len(b.text), b.in_article)

    def mostly(node: Node) -> bool:
        return (2 * node.article_chars > root.article_chars
                or (node.chars >= MOST_CHARS and 2 * node.chars > root.chars))

    def above(node: Node | None) -> Iterator[Node]:
        while node:
            yield node
            node = node.parent

    # Named elements around each sentence. Few elements hold most of a text, each within the one before.
    found: dict[int, Node] = {id(n): n for b in blocks for n in above(b.node) if n.named and mostly(n)}
    sentences = [(b.in_article, {id(n) for n in above(b.node) if n.named}) for b in blocks if found and b.sentence()]
    wrappers: set[int] = set()
    for one in sorted(found.values(), key=lambda n: sum(1 for _ in above(n))):
        upper = {id(n) for n in above(one)}
        inside = any(n.article for n in above(one))
        if root.article_chars and not inside:
            wraps = one.around and 2 * one.article_chars > root.article_chars
        else:
            wraps = not any(
                (of_article or not inside) and id(one) not in names and names <= wrappers | upper
                for of_article, names in sentences)
        if wraps:
            wrappers.add(id(one))

    known: dict[int, int] = {}

    def names(node: Node | None) -> int:
        """How many names count for an element."""
        new = []
        while node and id(node) not in known:
            new.append(node)
            node = node.parent
        n = known[id(node)] if node else 0
        for one in reversed(new):
            n += one.named and id(one) not in wrappers
            known[id(one)] = n
        return n

    out = []
    for i, b in enumerate(blocks):
        if names(b.node):
            out.append(Block(f"{b.path}!", b.text, b.links, b.in_article, b.heading, b.node, True))
            continue
        apart = [p for p in pieces.get(i, ()) if p[2] and names(p[2])]
        if not apart:
            out.append(b)
            continue
        rest = [p for p in pieces[i] if not (p[2] and names(p[2]))]
        for path, found, named in ((b.path, rest, False), (f"{b.path}!", apart, True)):
            text = " ".join("".join(p[0] for p in found).split())
            if text:
                out.append(Block(path, text, min(sum(p[1] for p in found), len(text)), b.in_article, b.heading, b.node, named))
    # Beside an empty article, adverts and the like are not the text.
    return [] if has_article and all(b.named for b in out) else out


def _smoothed(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d in range(-len(KERNEL) + 1, len(KERNEL)):
            if 0 <= i + d < len(values):
                total += KERNEL[abs(d)] * values[i + d]
                weight += KERNEL[abs(d)]
        out.append(total / weight)
    return out


def _marked(blocks: list[Block]) -> bool:
    """Whether article and main elements hold most of the text outside links."""
    inside = sum(len(b.text) - b.links for b in blocks if b.in_article and not b.named)
    return 2 * inside > sum(len(b.text) - b.links for b in blocks if not b.named)


def content_paths(blocks: list[Block], threshold: float = THRESHOLD) -> set[str]:
    """The paths whose fused ratio reaches ``threshold`` of the best."""
    chars: dict[str, int] = {}
    marks: dict[str, int] = {}
    links: dict[str, int] = {}
    nodes: dict[str, int] = {}
    for b in blocks:
        chars[b.path] = chars.get(b.path, 0) + len(b.text)
        marks[b.path] = marks.get(b.path, 0) + len(_PUNCTUATION.findall(b.text))
        links[b.path] = links.get(b.path, 0) + b.links
        nodes[b.path] = nodes.get(b.path, 0) + 1
    text = [math.log1p(chars[b.path] / nodes[b.path]) for b in blocks]
    punctuation = [math.log1p(marks[b.path] / nodes[b.path]) for b in blocks]
    own = [t * (1.0 + p) for t, p in zip(text, punctuation, strict=True)]
    near = [t * (1.0 + p) for t, p in zip(_smoothed(text), _smoothed(punctuation), strict=True)]
    outside = OUTSIDE if _marked(blocks) else 1.0
    fused: dict[str, float] = {}
    for b, o, s in zip(blocks, own, near, strict=True):
        value = math.sqrt(o * s) * (1.0 - links[b.path] / chars[b.path]) * (1.0 if b.in_article else outside)
        if b.named:
            value *= NAMED
        fused[b.path] = fused.get(b.path, 0.0) + value / nodes[b.path]
    if any(b.sentence() or (b.in_article and b.links < len(b.text)) for b in blocks if not b.named):
        for b in blocks:
            if b.named:
                fused.pop(b.path, None)
    best = max(fused.values(), default=0.0)
    return {path for path, value in fused.items() if value > 0 and value >= threshold * best}


def main_blocks(blocks: list[Block], threshold: float = THRESHOLD) -> list[Block]:
    paths = content_paths(blocks, threshold)
    parents = {path.rpartition("/")[0] for path in paths}
    places = [b.node.container() for b in blocks]
    chars: dict[int, int] = {}
    links: dict[int, int] = {}
    for i, (b, (inner, outer)) in enumerate(zip(blocks, places, strict=True)):
        chars[id(outer)] = chars.get(id(outer), 0) + len(b.text)
        links[id(outer)] = links.get(id(outer), 0) + b.links
        if b.path in paths:
            inner.first, inner.last = inner.first if inner.first >= 0 else i, i
            node = inner
            while node and node.high < i:
                node.low, node.high = node.low if node.low >= 0 else i, i
                node = node.parent
    marked = _marked(blocks)

    def stays(i: int) -> bool:
        b, (inner, outer) = blocks[i], places[i]
        if b.path in paths:
            return True
        if b.named:
            return False
        if b.heading:
            # A heading stands before what it names.
            return b.path.rpartition("/")[0] in parents or (inner.high > i and (b.in_article or not marked))
        if links[id(outer)] >= LINKS * chars[id(outer)]:
            return False
        if b.node.tag in TEXT and (inner.first >= 0 or inner.low < i < inner.high):
            return True
        node = inner
        while node and not node.first < i < node.last:
            node = node.parent
        return node is not None

    return [b for i, b in enumerate(blocks) if stays(i)]


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    return "\n".join(b.text for b in main_blocks(text_blocks(html or ""), threshold))


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text",
                 threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``text_col`` (replaced if there is one) and drops the html; other columns pass through."""
    rest = [c for c in pages.columns if c not in (html_col, text_col)]
    rows = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{html_col}`").cast("string").alias(html_col))
    schema = pages.select(*[F.col(f"`{c}`") for c in rest]).schema.add(text_col, "string")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), threshold) for h in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(rest)], pa.array(texts, pa.string())], names=[*rest, text_col])

    return rows.mapInArrow(extract, schema)
