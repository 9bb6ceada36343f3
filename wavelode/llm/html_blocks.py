"""Blocks of text in an HTML page, with the region of the page that each is in.

Reads a page once from left to right, in time proportional to its length, and tolerates
what browsers tolerate: unclosed elements, stray ends, cut pages.
"""

from __future__ import annotations

import re
from html import unescape

#: Regions: the rest of the body, <main>, the article, and what is no main text.
BODY, MAIN, ARTICLE, CHROME = 0, 1, 2, 3
#: Only while reading: an article's header, whose headings belong to it, and chrome by a class name, in which an article may still begin.
HEADER, WEAK = 4, 5

_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?|["'])*+)(?:>|\Z)"""
    r"""|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: Elements whose content is not text of the page; they end at their own end tag only.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "noframes", "noembed", "xmp")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_FORMAT = set("abbr acronym b bdi bdo big center cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt rtc s samp small strike strong sub sup time tt u var".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that end where one of the same group begins.
_CLOSES = {t: group for group in (("p",), ("li",), ("dt", "dd"), ("tr", "td", "th"), ("td", "th"), ("option",)) for t in group}

#: What is no main text, by element, by role and by a part of a class or id.
_CHROME_TAGS = set("nav aside footer form menu dialog search select button svg canvas object template head".split())
_CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_CHROME_NAMES = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login comments comment disqus reply replies respond share sharing social related recommended pagination pager".split()
)
_COMMENTS = {"comment", "comments", "disqus", "reply", "replies", "respond"}
_ARTICLE_NAMES = {"article-body", "article-content", "articlebody", "entry-content", "post-content", "post-body", "story-body"}
#: Before a name these say that something else has, or lacks, such a part.
_ABOUT = {"with", "has", "no", "without"}


def _region(tag: str, attributes: str, now: int) -> int:
    """The region inside an element that begins in region ``now``."""
    if now == CHROME or tag in ("html", "body"):
        return now
    found = {name.lower(): a or b or c for name, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    role, names = found.get("role", "").lower(), f"{found.get('class', '')} {found.get('id', '')}"
    pieces = set()
    for name in names.split():
        before = ""
        for piece in _PIECE.findall(name):
            if before not in _ABOUT:
                pieces.add(piece.lower())
            before = piece.lower()
    if tag in _CHROME_TAGS or role in _CHROME_ROLES or pieces & _COMMENTS:
        return CHROME
    if tag == "article" or role == "article" or "articlebody" in found.get("itemprop", "").lower().split() or set(names.lower().split()) & _ARTICLE_NAMES:
        return ARTICLE
    if now == WEAK:
        return MAIN if tag == "main" or role == "main" else WEAK
    if tag in _HEADINGS and now == HEADER:
        return ARTICLE
    if tag in _HEADINGS or tag in ("article", "main"):
        pieces -= {"header", "masthead"}
    if tag == "header" or pieces & {"header", "masthead"}:
        return HEADER if now in (ARTICLE, HEADER) else WEAK
    if pieces & _CHROME_NAMES and tag != "main":
        return WEAK
    if (tag == "main" or role == "main") and now == BODY:
        return MAIN
    return now


def page_blocks(html: str) -> list[tuple[str, int, int]]:
    """(text, region, words in links) of every block with text, in page order.

    A block ends where a block-level element begins or ends; line breaks are white space.
    Character references are decoded, white space runs become one space and the ends are
    trimmed. Text of another region inside a block, such as an advert in a sentence, is a
    block of its own after it.
    """
    found: list[tuple[str, int, int]] = []
    parts: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int, int]] = []
    opened: dict[str, int] = {}
    region, links, at, end = BODY, 0, 0, len(html)

    def flush() -> None:
        for kind in dict.fromkeys(r for _, r, _ in parts):
            words = "".join(t for t, r, _ in parts if r == kind).split()
            if words:
                found.append((" ".join(words), kind if kind <= CHROME else CHROME, sum(len(t.split()) for t, r, a in parts if a and r == kind)))
        parts.clear()

    def pop() -> None:
        nonlocal region, links
        tag, region, links = stack.pop()
        opened[tag] -= 1

    while at < end:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else end]
        if text:
            parts.append((unescape(text), region, links > 0))
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            parts.append((" ", region, False))
        if m[1]:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _RAW:
            close = _RAW[tag].search(html, at)
            at = close.end() if close else end
            continue
        if tag in _VOID or tag in _FORMAT:
            continue
        if tag in _BLOCK and stack and stack[-1][0] == "p":
            pop()
        while tag in _CLOSES and stack and stack[-1][0] in _CLOSES[tag]:
            pop()
        stack.append((tag, region, links))
        opened[tag] = opened.get(tag, 0) + 1
        region, links = _region(tag, m[3], region), links + (tag == "a")
    flush()
    return found
