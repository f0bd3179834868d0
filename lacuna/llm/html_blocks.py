"""Web pages as blocks of text, each with the element that holds it. Linear in a page's length."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

_A = re.ASCII
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)", _A)
_INSIDE = re.compile(r"[^>\"']*+")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s=/>]++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]++))?", _A)
_HREF = re.compile(r"\bhref\b", re.I | _A)
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I | _A)

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Their content is text until their end tag, and none of it is the page's text.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Controls, drawings and what shows only where something else does not; without an end tag they are passed over.
LEFT_OUT = frozenset("noscript template svg math select button canvas object video audio".split())
_END = {x: re.compile(rf"</{x}(?=[\s/>]|$)", re.I | _A) for x in RAW | LEFT_OUT}
#: A start tag closes these if one of them is the innermost open element of their kind.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
_CLOSES |= {x: {"td", "th", "tr", "tbody", "thead", "tfoot", "caption"} for x in ("tbody", "thead", "tfoot")}
_KIND = {x: "list" for x in ("ul", "ol", "menu", "dir", "li")} | {x: "terms" for x in ("dl", "dt", "dd")} | {x: "table" for x in ("table", "tbody", "thead", "tfoot", "caption", "tr", "td", "th")}


@dataclass
class Page:
    """Elements in page order, the first the page itself: tags, parents, names (class, id and role); hidden ones. Blocks in
    page order: texts, their elements, how many characters of each are in links."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    parents: list[int] = field(default_factory=lambda: [-1])
    names: list[str] = field(default_factory=lambda: [""])
    hidden: list[bool] = field(default_factory=lambda: [False])
    texts: list[str] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def _tag_end(html: str, at: int) -> int:
    """The place of the '>' that ends the tag, or the page's length; a quote that nothing closes is a character."""
    size = len(html)
    while at < size:
        at = _INSIDE.match(html, at).end()
        if at >= size or html[at] == ">":
            return at
        close = html.find(html[at], at + 1)
        at = close + 1 if close >= 0 else at + 1
    return size


def parse(html: str) -> Page:
    page, size, at = Page(), len(html), 0
    stack, counts = [0], {}
    scopes: dict[str, list[int]] = {"list": [], "terms": [], "table": []}
    held: list[str] = []
    linked, link = 0, 0  # link: how deep the stack was where an open link began
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                page.texts.append(text)
                page.owners.append(stack[-1])
                page.linked.append(min(linked, len(text)))
        linked = 0

    def pop() -> None:
        nonlocal link
        tag = page.tags[stack.pop()]
        counts[tag] -= 1
        if tag in _KIND:
            scopes[_KIND[tag]].pop()
        if len(stack) < link:
            link = 0

    def close(tag: str) -> None:
        while page.tags[stack[-1]] != tag:
            pop()
        pop()

    def put(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        held.append(text)
        if link:
            linked += len(text.strip())

    while at < size:
        start = html.find("<", at)
        if start < 0:
            put(html[at:])
            break
        if start > at:
            put(html[at:start])
        named = _NAME.match(html, start + 1)
        if not named:
            mark = html[start + 1 : start + 2]
            if html.startswith("<!--", start):
                end = start + 4 if html.startswith((">", "->"), start + 4) else html.find("-->", start + 4)
                at = size if end < 0 else html.find(">", end) + 1
            elif mark in ("!", "?", "/") and mark:
                end = html.find(">", start)
                at = size if end < 0 else end + 1
            else:
                put("<")
                at = start + 1
            continue
        tag, ends = named[2].lower(), bool(named[1])
        end = _tag_end(html, named.end())
        if end >= size:  # a tag without an end is no text
            break
        at = end + 1
        if tag in BLOCK:
            flush()
            if tag in ("html", "body"):
                continue
            if ends:
                if counts.get(tag):
                    close(tag)
                continue
            if counts.get("p") and tag != "p" or tag == "p" and page.tags[stack[-1]] == "p":
                if page.tags[stack[-1]] == "p":
                    pop()
            kind = _KIND.get(tag)
            if kind:
                scope = scopes[kind]
                while scope and page.tags[stack[scope[-1]]] in _CLOSES.get(tag, ()):
                    for _ in range(len(stack) - scope[-1]):
                        pop()
                scope.append(len(stack))
            names, hidden = [], False
            if named.end() < end:
                for name, value in _ATTRIBUTE.findall(html[named.end() : end]):
                    name, value = name.lower(), value.strip("\"'")
                    if name in ("class", "id", "role"):
                        names.append(unescape(value))
                    elif name == "hidden" or name == "style" and _UNSEEN.search(value):
                        hidden = True
            page.tags.append(tag)
            page.parents.append(stack[-1])
            page.names.append(" ".join(names))
            page.hidden.append(hidden)
            stack.append(len(page.tags) - 1)
            counts[tag] = counts.get(tag, 0) + 1
        elif tag == "a":
            link = 0 if ends else len(stack) if _HREF.search(html, named.end(), end) else link
        elif tag == "br":
            held.append(" ")
        elif tag == "hr":
            flush()
        elif not ends and (tag in RAW or tag in LEFT_OUT) and tag not in unclosed:
            if tag in ("svg", "math") and html[end - 1] == "/":
                continue
            found = _END[tag].search(html, at)
            if found:
                at = html.find(">", found.end()) + 1 or size
            elif tag in RAW:
                break
            else:
                unclosed.add(tag)
    flush()
    return page
