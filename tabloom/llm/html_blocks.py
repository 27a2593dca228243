"""Flat text blocks of an HTML page, with what surrounds each of them."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAMES = re.compile(r"[a-z]+")
# fixed values: first parts of class names that tell of a page's layout, as in "no-sidebar" or "has-header-image"
LAYOUT_NAMES = {"no", "not", "has", "have", "with", "without", "is", "layout"}

# fixed values: elements whose content is not text
RAW = {"script", "style", "noscript", "template", "svg", "math", "textarea", "title", "iframe", "object", "canvas", "audio", "video", "select"}
# fixed values: elements that stay inside a line of text
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input",
          "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
# fixed values: elements without an end
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# fixed values: elements that hold something else than the article
ASIDE = {"nav", "footer", "aside", "form", "menu", "button", "dialog", "fieldset"}
# fixed values: words of class, id and role names of such parts
ASIDE_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
               "comments", "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "header",
               "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup",
               "promo", "promoted", "promotion", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social",
               "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "widgets"}
# fixed values: names of parts that may hold article elements which are no articles of the page
ENTRY_NAMES = {"comment", "comments", "commentlist", "disqus", "replies", "respond", "related", "promo", "promoted", "widget", "widgets"}
ARTICLE_NAMES = {"article", "main", "story", "post", "entry", "articlebody"}


class Block(NamedTuple):
    """Text between block-level tags; ``links`` are the words inside links."""

    text: str
    words: int
    links: int
    heading: bool
    inside: bool       # in the article's or page's main element
    aside: bool        # in an element that names another part


class Link(NamedTuple):
    href: str
    text: str


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag, the first of a name counting."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def _names(raw: str) -> set[str]:
    """Words of an element's class, id and role names; names that tell of the page's layout are left out."""
    if not raw or not ("class" in raw or "id" in raw or "role" in raw):
        return set()
    a = attributes(raw)
    parts = [_NAMES.findall(name) for k in ("class", "id", "role") if k in a for name in a[k].lower().split()]
    return {w for p in parts if p and p[0] not in LAYOUT_NAMES for w in p}


def _part(name: str, raw: str, inside: bool, aside: int) -> tuple[bool, int]:
    """Whether the content of an element lies in the main part, and how far in another part of the page.

    Another part is 2 where it may hold articles of its own (comments, related
    ones, asides), else 1.  A main or article element ends a part of degree 1: a
    form or a frame around the article does not make it something else.
    """
    main = name in ("article", "main")
    other = 2 if name in ("nav", "footer", "aside") else int(name in ASIDE or name == "header" and not inside)
    names = _names(raw) if name not in ("html", "body") else set()
    if inside:
        names.discard("header")             # an article's own head
    if main:
        if names & ENTRY_NAMES:
            return inside, 2
        return True, 0 if aside < 2 else aside
    if names & ASIDE_NAMES:
        other = max(other, 2 if names & ENTRY_NAMES else 1)
    main = bool(names & ARTICLE_NAMES) and not other
    return inside or main, max(aside, other)


def read_page(html: str) -> tuple[list[Block], list[Link], str]:
    """Blocks in page order, links, and the title."""
    blocks: list[Block] = []
    links: list[Link] = []
    open_: list[tuple[str, bool, int]] = []       # name, inside, aside
    inside = heading = False
    aside = 0
    parts: list[str] = []
    link_parts: list[str] | None = None
    link_words = 0
    href = title = ""

    def end_link():
        nonlocal link_parts, link_words
        if link_parts is not None:
            text = " ".join(unescape("".join(link_parts)).split())
            link_words += len(text.split())
            if href:
                links.append(Link(href, text))
            link_parts = None

    def end_block():
        nonlocal parts, link_words, link_parts
        again = link_parts is not None
        end_link()
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            n = text.count(" ") + 1
            blocks.append(Block(text, n, min(link_words, n), heading, inside, aside > 0))
        parts, link_words = [], 0
        if again:
            link_parts = []

    at = 0
    while True:
        m = _TAG.search(html, at)
        text = html[at:m.start()] if m else html[at:]
        if text:
            parts.append(text)
            if link_parts is not None:
                link_parts.append(text)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:                    # comment, doctype or the like
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        closing, raw = m[1], m[3]
        if name in RAW and not closing:
            if raw.endswith("/"):
                continue
            e = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            if name == "title" and not title:
                title = " ".join(unescape(html[at:e.start() if e else len(html)]).split())
            at = e.end() if e else len(html)
            if name not in INLINE:
                end_block()
            continue
        if name == "a":
            end_link()
            if not closing:
                href, link_parts = attributes(raw).get("href", ""), []
            continue
        if name in INLINE and not (name in ("span", "label") and raw):
            if name in ("br", "img", "input", "wbr"):
                parts.append("" if name == "wbr" else " ")
            continue
        if name in INLINE and _part(name, raw, inside, aside)[1] <= aside:
            open_.append((name, inside, aside)) if not closing else None
            continue
        if closing and name in INLINE:
            continue
        end_block()
        heading = False
        if closing:
            k = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if k is not None:
                _, inside, aside = open_[k]
                del open_[k:]
            continue
        if open_ and open_[-1][0] == name and name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") or open_ and open_[-1][0] == "p":
            _, inside, aside = open_.pop()  # such an element ends where the next one begins
        if len(name) == 2 and name[0] == "h" and name[1].isdigit():
            heading = True
        if name in VOID or raw.endswith("/"):
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and not raw.strip():
            continue                        # their ends are often left out, and they name no part
        open_.append((name, inside, aside))
        inside, aside = _part(name, raw, inside, aside)
    end_block()
    return blocks, links, title
