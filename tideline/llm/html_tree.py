"""Block trees of HTML pages, as flat arrays over many pages.

A node is a block-level element, or a text block: a run of text and inline
elements between block bounds. Nodes are in page order, parents first.
Malformed markup is taken as browsers do in the common cases: open paragraphs
and list items are closed by what cannot stand inside them, stray end tags are
ignored, unclosed elements end with the page. Open elements are looked up by
name, so the time is linear in the page however deep its nesting is.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass
from html import unescape

import numpy as np

# Element classes.
GROUPS: dict[str, str] = {
    "text": "#text", "paragraph": "p", "heading": "h1 h2 h3 h4 h5 h6", "item": "li dt dd", "list": "ul ol dl dir", "div": "div center",
    "section": "section hgroup details summary", "article": "article main", "nav": "nav menu", "aside": "aside", "header": "header",
    "footer": "footer address", "form": "form fieldset legend label search dialog", "table": "table caption thead tbody tfoot tr td th colgroup",
    "quote": "blockquote pre figure figcaption", "body": "body html frameset", "other": "hr",
}
GROUP_NAMES = list(GROUPS)
BLOCKS = {tag: code for code, tags in enumerate(GROUPS.values()) for tag in tags.split()}
DROPPED = frozenset("script style noscript template iframe object embed svg canvas audio video map title textarea select button datalist noembed noframes xmp applet".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_PARAGRAPH = frozenset(BLOCKS) - {"#text", "html", "body", "label", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup", "dt", "dd", "li"} | {"li", "dt", "dd"}
#: An opening tag closes these open elements, up to the nearest of the bounds.
IMPLIED: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])), "tfoot": (frozenset(["thead", "tbody", "tr", "td", "th"]), frozenset(["table"])),
}
# Words of class, id and role attributes.
CONTENT_WORDS = frozenset("article articlebody post entry content story main text body prose copy paragraph blogpost richtext page maincontent".split())
OTHER_WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead topbar footer foot bottom sidebar side aside rail ad ads adv advert advertisement adslot adsense banner promo promotion sponsor sponsored sponsors "
    "cookie cookies consent gdpr notice notices notification alert warning disclaimer popup modal overlay dialog comment comments commentlist reply replies respond disqus discussion feedback responses response reader share sharing social "
    "follow related recommended recommendations more popular trending breadcrumb breadcrumbs crumbs pagination pager paging widget widgets subscribe subscription newsletter signup login register search form toolbar copyright legal "
    "complementary contentinfo hidden skip links tags tagcloud toc outbrain taboola teaser paywall donate announcement".split()
)
_TOKEN = re.compile(r"<!--(?:.*?--!?>|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|<[!?/][^>]*(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style|href)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
COUNTS = ["chars", "words", "links", "stops", "commas", "controls", "copyright", "tags", "blocks", "paragraphs"]


@dataclass
class Forest:
    """Nodes of many pages; ``page[i]`` has nodes ``first[i]:first[i+1]``."""

    first: np.ndarray
    parent: np.ndarray
    group: np.ndarray
    last: np.ndarray
    depth: np.ndarray
    content_words: np.ndarray
    other_words: np.ndarray
    counts: np.ndarray
    texts: list[str | None]


def attribute_words(attributes: str) -> tuple[int, int, bool]:
    """How many attribute words speak for content and against it; whether the element links somewhere."""
    content = other = 0
    link = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "href":
            link = True
        elif name in ("class", "id", "role"):
            for word in _WORD.findall(value):
                word = word.lower()
                content += word in CONTENT_WORDS
                other += word in OTHER_WORDS
        elif name == "style":
            other += 2 * ("display:none" in value.replace(" ", "").lower())
        elif name == "hidden" or value.lower() == "true":
            other += 2
    return content, other, link


def _element_ends(html: str, name: str) -> dict[int, int]:
    """Where each closed element of a name ends, by where it begins; they may be nested."""
    open_at, out = [], {}
    for tag in re.finditer(f"<(/?){name}(?=[\\s/>])[^>]*?(/?)>", html, re.I):
        if tag.group(1):
            if open_at:
                out[open_at.pop()] = tag.end()
        elif tag.group(2):
            out[tag.start()] = tag.end()
        else:
            open_at.append(tag.start())
    return out


class _Builder:
    def __init__(self) -> None:
        self.parent: list[int] = []
        self.group: list[int] = []
        self.last: list[int] = []
        self.depth: list[int] = []
        self.content: list[int] = []
        self.other: list[int] = []
        self.counts: list[tuple] = []
        self.texts: list[str | None] = []

    def page(self, html: str) -> None:
        parent, group, last, depth, content, other, counts, texts = self.parent, self.group, self.last, self.depth, self.content, self.other, self.counts, self.texts
        root = len(parent)
        stack: list[tuple[str, int]] = [("body", root)]
        #: Where on the stack the open elements of a name are, and where dropped elements end.
        heights: dict[str, list[int]] = defaultdict(list, body=[0])
        ends: dict[str, dict[int, int]] = {}
        parent.append(-1), group.append(BLOCKS["body"]), last.append(0), depth.append(0), content.append(0), other.append(0), counts.append((0,) * len(COUNTS)), texts.append(None)
        pieces: list[str] = []
        linked = tags = controls = 0
        in_link = False
        leaf = BLOCKS["#text"]

        def flush() -> None:
            nonlocal linked, tags, controls
            if pieces or controls:
                text = " ".join("".join(pieces).split())
                if text or controls:
                    chars = len(text)
                    parent.append(stack[-1][1]), group.append(leaf), last.append(len(parent)), depth.append(len(stack)), content.append(0), other.append(0)
                    counts.append((chars, text.count(" ") + bool(text), min(linked, chars), text.count(".") + text.count("!") + text.count("?"), text.count(","), controls, "©" in text, tags, 1, stack[-1][0] == "p"))
                    texts.append(text)
                pieces.clear()
            linked = tags = controls = 0

        def close(height: int) -> None:
            while len(stack) > height:
                name, node = stack.pop()
                last[node] = len(parent)
                heights[name].pop()

        at, end = 0, len(html)
        while at < end:
            token = _TOKEN.search(html, at)
            stop = token.start() if token else end
            if stop > at:
                text = unescape(html[at:stop])
                pieces.append(text)
                if in_link:
                    linked += len(text.strip())
            if token is None:
                break
            at = token.end()
            name = token.group(2) or token.group(5)
            if name is None:
                continue
            name = name.lower()
            if token.group(1) or token.group(4):
                if name in BLOCKS:
                    if name in ("body", "html"):
                        continue
                    flush()
                    if heights[name]:
                        close(heights[name][-1])
                elif name == "a":
                    in_link = False
                continue
            tags += 1
            attributes = token.group(3) or token.group(6) or ""
            if name in DROPPED:
                controls += name in ("textarea", "select", "button")
                if name in VOID:
                    continue
                if name in RAW:
                    closing = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                    at = closing.end() if closing else end
                else:
                    if name not in ends:
                        ends[name] = _element_ends(html, name)
                    # Never closed: drop the tag alone, as the rest of the page may be the article.
                    at = ends[name].get(token.start(), at)
                continue
            if name not in BLOCKS and "-" not in name:
                if name == "br":
                    pieces.append(" ")
                elif name == "a":
                    in_link = attribute_words(attributes)[2]
                elif name == "input":
                    controls += 1
                continue
            if name in ("html", "body"):
                good, bad, _ = attribute_words(attributes)
                content[root] += good
                continue
            flush()
            in_link = in_link and name not in ("nav", "article", "section", "div", "ul", "footer")
            if name in CLOSES_PARAGRAPH:
                if heights["p"]:
                    close(heights["p"][-1])
            if name in IMPLIED:
                closed, bounds = IMPLIED[name]
                bound = max((heights[b][-1] for b in bounds if heights[b]), default=0)
                inside = [h[k] for c in closed if (h := heights[c]) and (k := bisect_right(h, bound)) < len(h)]
                if inside:
                    close(min(inside))
            good, bad, _ = attribute_words(attributes) if attributes else (0, 0, False)
            parent.append(stack[-1][1]), group.append(BLOCKS.get(name, BLOCKS["div"])), last.append(0), depth.append(len(stack)), content.append(good), other.append(bad), counts.append((0, 0, 0, 0, 0, 0, 0, 1, 0, 0)), texts.append(None)
            if name in VOID:
                last[-1] = len(parent)
            else:
                heights[name].append(len(stack))
                stack.append((name, len(parent) - 1))
        flush()
        close(0)


def plant(pages: list[str]) -> Forest:
    """Trees of some pages."""
    builder, first = _Builder(), [0]
    for html in pages:
        builder.page(html)
        first.append(len(builder.parent))
    whole = lambda x, kind=np.int64: np.array(x, kind)
    return Forest(
        whole(first), whole(builder.parent), whole(builder.group), whole(builder.last), whole(builder.depth), whole(builder.content), whole(builder.other),
        np.array(builder.counts, np.float64).reshape(-1, len(COUNTS)), builder.texts,
    )
