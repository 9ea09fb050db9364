"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window.
WINDOW = 3

_OPEN = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ROUGH = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z]+")
_BLANKS = re.compile(r"\s+")

#: Text that is no text of the page, up to the end tag of the same name.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
#: Elements left out with all they hold, as if they were not there.
BARRED = {
    "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "noscript", "template", "svg",
    "math", "audio", "video", "canvas", "object", "head", "map", "datalist",
}
MAIN = {"article", "main"}
#: Elements that are tracked; an end tag closes the nearest open one of its name and what is open within.
NESTED = BARRED | MAIN | {
    "html", "body", "section", "div", "ul", "ol", "dl", "table", "figure", "details", "center", "blockquote", "span", "p", "li",
    "h1", "h2", "h3", "h4", "h5", "h6",
}
#: Elements that end a block.
BLOCKS = NESTED - {"span", "button", "select", "svg", "math", "audio", "video", "canvas", "object", "map"} | {
    "address", "caption", "dd", "dt", "figcaption", "hr", "legend", "optgroup", "option", "pre", "summary", "tbody", "tfoot",
    "thead", "tr",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An open paragraph, heading or list item ends where one of these begins.
LEAVES = {"p"} | HEADINGS
BARRED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Words of a class or id that name what is seldom main text: lines in such an element weigh a tenth.
LIGHT_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion",
    "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "newsletter", "subscribe", "signup", "login", "social",
    "share", "sharing", "related", "recommended", "recommendations", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "footer", "popup", "modal", "toolbar", "pagination", "pager", "copyright", "disclaimer",
}
#: Words that say so of a whole page's parts, and nothing of an article's.
OUTER_WORDS = {"header", "masthead", "search", "widget", "widgets", "overlay"}
LIGHT = 0.1
#: Where the page marks an article, lines outside it weigh a twentieth.
OUTSIDE = 0.05
#: Part of a page's typical window sum that a window must reach.
LEVEL = 0.2
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
#: Words that name main text; an element named by them too is not barred.
MAIN_WORDS = {"content", "article", "post", "entry", "story", "main", "body", "text"}


#: Elements that hold the lines of one text.
HOLDERS = MAIN | {"html", "body", "div", "section", "center", "td"}
_LEGAL = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)


@dataclass
class _Element:
    name: str
    kind: str  # what its siblings of the same kind share: name and class
    parent: _Element | None
    holder: _Element | None  # the nearest element that holds lines, itself included
    barred: bool
    light: bool
    lines: int = 0


@dataclass
class _Page:
    """Lines, each with what the distribution knows of it."""

    texts: list[str] = field(default_factory=list)
    free: list[int] = field(default_factory=list)  # characters outside links
    inside: list[bool] = field(default_factory=list)  # of an article or main element
    light: list[bool] = field(default_factory=list)
    heading: list[bool] = field(default_factory=list)
    owner: list[_Element] = field(default_factory=list)
    block: list[str] = field(default_factory=list)
    linked: int = 0

    def flush(self, stack: list[_Element], inside: bool) -> None:
        if self.block:
            text = _BLANKS.sub(" ", markup.unescape("".join(self.block))).strip()
            if text:
                self.texts.append(text)
                self.free.append(max(0, len(text) - self.linked))
                self.inside.append(inside)
                self.light.append(any(e.light for e in stack))
                self.heading.append(any(e.name in HEADINGS for e in stack))
                self.owner.append(stack[-1])
                above = stack[-1]
                while above:
                    above.lines += 1
                    above = above.parent
        self.block, self.linked = [], 0


def _named(attributes: str) -> dict[str, str]:
    named = {}
    if attributes and not attributes.isspace():
        for key, *value in _ATTRIBUTE.findall(attributes):
            named.setdefault(key.lower(), markup.unescape("".join(value)).lower())
    return named


def _element(name: str, attributes: str, parent: _Element, in_main: bool, forms: bool) -> _Element:
    named = _named(attributes)
    words = set(_TOKEN.findall(named.get("class", "") + " " + named.get("id", "")))
    root = name in ("html", "body")
    barred = not root and (
        (name in BARRED and not (name in ("form", "fieldset") and not forms))
        or "hidden" in named
        or named.get("aria-hidden") == "true"
        or "display:none" in named.get("style", "").replace(" ", "")
        or named.get("role") in BARRED_ROLES
        or bool(words & COMMENT_WORDS)
    )
    light = not root and name not in MAIN | HEADINGS and not words & MAIN_WORDS and bool(
        words & LIGHT_WORDS or (not in_main and words & OUTER_WORDS)
    )
    out = _Element(name, f"{name}.{named.get('class', '')}", parent, None, barred, light)
    out.holder = out if name in HOLDERS else parent.holder
    return out


def _lines(page: str, forms: bool) -> _Page:
    out = _Page()
    top = _Element("", "", None, None, False, False)
    top.holder = top
    stack = [top]  # open elements
    barred = mains = links = headings = 0

    def leave(depth: int) -> None:
        nonlocal barred, mains, headings
        while len(stack) > depth:
            gone = stack.pop()
            barred -= gone.barred
            mains -= gone.name in MAIN
            headings -= gone.name in HEADINGS

    def add(text: str) -> None:
        # an article's own header gives its headings
        if text and (not barred or (headings and mains and [e.name for e in stack if e.barred] == ["header"])):
            out.block.append(text)
            out.linked += len(text) if links else 0

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or page.find(">", lt) < 0:
            add(page[at:] if lt < 0 else page[at:lt])
            break
        add(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        follows = page[lt + 1 : lt + 2]
        if follows in ("!", "?"):
            at = page.find(">", lt) + 1
            continue
        m = _OPEN.match(page, lt) or _ROUGH.match(page, lt)
        if not m:
            add("<")
            at = lt + 1
            continue
        name, at = m[1].lower(), m.end()
        closing = page[lt + 1] == "/"
        if name in BLOCKS:
            out.flush(stack, mains > 0)
        elif name in ("br", "td", "th", "img", "wbr"):
            out.block.append("" if name == "wbr" else " ") if out.block else None
        if closing:
            if name == "a":
                links = max(0, links - 1)
            if name in NESTED:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), None)
                if depth is not None:
                    leave(depth)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
            continue
        if name == "a":
            links = 1  # links do not nest
        elif name in NESTED and not m[2].rstrip().endswith("/") or name in NESTED and name not in ("svg", "math"):
            if name in BLOCKS and stack[-1].name in LEAVES:
                leave(len(stack) - 1)
            elif name == "li" and stack[-1].name == "li":
                leave(len(stack) - 1)
            if name in MAIN:  # an article is no part of what a missing end tag left open before it
                while barred and stack[-1].name in ("nav", "header", "form", "head", "ul", "ol", "li", "p"):
                    leave(len(stack) - 1)
            element = _element(name, m[2], stack[-1], mains > 0, forms)
            if element.barred and not barred:
                out.flush(stack, mains > 0)
            stack.append(element)
            barred += element.barred
            mains += name in MAIN
            headings += name in HEADINGS
    out.flush(stack, mains > 0)
    return out


def _holders(page: _Page) -> list[_Element]:
    """The element whose text each line belongs to: an article or main element with all in it, else the nearest holder;
    a holder that is a line itself belongs to the one around it."""
    out = []
    for owner, inside in zip(page.owner, page.inside):
        at = owner.holder
        if inside:
            while at.name not in MAIN:
                at = at.parent.holder
        elif at is owner and at.lines == 1 and at.parent and at.name not in ("html", "body"):
            at = at.parent.holder
        out.append(at)
    return out


def _weights(page: _Page) -> np.ndarray:
    """Lengths as the distribution sees them. A line that is links for three quarters weighs nothing."""
    weights = np.array([f if 4 * f >= len(t) else 0 for t, f in zip(page.texts, page.free)], dtype=np.float64)
    inside = np.array(page.inside, dtype=bool)
    if (weights * inside).any():
        weights[~inside] *= OUTSIDE
    weights[np.array(page.light, dtype=bool)] *= LIGHT
    return weights


def _surges(weights: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, float]:
    """Which lines lie between a surge and a dive, and the level: a part of the window sum that a character of the page
    has around it on average. Windows are centred and reach no line of another holder."""
    half = WINDOW // 2
    sums = weights.copy()
    for k in range(1, half + 1):
        near = holders[k:] == holders[:-k]
        sums[k:] += np.where(near, weights[:-k], 0)
        sums[:-k] += np.where(near, weights[k:], 0)
    level = LEVEL * float((sums * weights).sum() / max(weights.sum(), 1e-9))
    return (sums >= level) & (sums > 0), level


def _chosen(page: _Page) -> np.ndarray:
    """The lines of the main text."""
    weights, held = _weights(page), _holders(page)
    light = np.array(page.light, dtype=bool)
    if not weights.any() or not weights[~light].any():
        return np.zeros(len(weights), dtype=bool)
    holders = np.unique([id(h) for h in held], return_inverse=True)[1]
    high, level = _surges(weights, holders)
    legal = np.array([bool(_LEGAL.match(t)) and len(t) < level for t in page.texts])
    outside = ~np.array(page.inside, dtype=bool) & any(page.inside)
    # what a surge may grow over: lines that are text and that nothing makes doubtful
    plain = (weights > 0) & ~light & ~legal & ~outside
    # within a range links stay, doubtful lines only if they weigh enough by themselves
    keep = high & np.where(light | outside | legal, weights >= level, True)
    if not (keep & (weights > 0)).any():
        return np.zeros(len(weights), dtype=bool)
    spots = np.flatnonzero(keep & (weights > 0))
    first, last = int(spots[0]), int(spots[-1])
    common = _common([held[i] for i in spots.tolist()])

    def same(i: int, j: int) -> bool:
        a, b = held[i], held[j]
        return a is b or (a.parent is b.parent and a.kind == b.kind and a.kind != "div.")

    # links at the ends of a range are menus beside the text
    n = len(weights)
    for order in (range(n), range(n - 1, -1, -1)):
        text = False
        for i in order:
            text = bool(keep[i]) and (text or weights[i] > 0)
            keep[i] &= text
    # short lines on either side, up to the dive: links, doubtful lines or another holder
    for order in (range(n), range(n - 1, -1, -1)):
        before = None
        for i in order:
            if keep[i]:
                before = i
            elif before is not None and plain[i] and same(before, i):
                keep[i], before = True, i
            elif not light[i]:  # what is doubtful does not part a text
                before = None
    # short lines between ranges of one element
    if common.name not in ("", "html", "body"):
        keep[first : last + 1] |= plain[first : last + 1]
    # headings that stand right before a range, in a holder of their own
    for i in range(n - 2, -1, -1):
        if keep[i + 1] and page.heading[i] and plain[i]:
            keep[i] = True
    return keep


def _common(elements: list[_Element]) -> _Element:
    """The innermost element that holds all of these."""

    def path(e: _Element) -> list[_Element]:
        out = [e]
        while out[-1].parent:
            out.append(out[-1].parent)
        return out[::-1]

    found = path(elements[0])
    for e in {id(x): x for x in elements[1:]}.values():
        other = path(e)
        found = [a for a, b in zip(found, other) if a is b]
    return found[-1]


def main_text(page: str | None) -> str:
    """The blocks of the main text, joined by a line feed."""
    for forms in (True, False):
        found = _lines(page or "", forms)
        text = "\n".join(t for t, keep in zip(found.texts, _chosen(found)) if keep)
        if text:
            return text
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row.

    Markup is stripped to lines, one for each block; a line weighs its characters outside links, nothing if links are three
    quarters of it. Elements that are never main text (menus, page headers and footers, sidebars, forms, hidden parts, reader
    comments; told by element, role or class) are left out as if they were not there. Words of class and id that name adverts,
    notices and the like only lower the weight of lines, as does standing outside of a page's article. Sums of weights
    over windows of lines are held against a level, a part of the page's own typical sum: text from a surge over the level to the
    dive after it is kept. A dive ends at links or where the element ends that holds the text, so short leads and closings
    stay, while menus, copyright lines, teasers and lists of links beside a text go, inside of an article too.
    Headings right before a kept range stay. Scripts, styles and markup comments are no text.
    Character references are decoded, white space (line breaks within a block too) becomes one space.
    A null, empty or textless page has text '' and 0. Elements left open end with the element around them. Rows that
    repeat are answered each by itself; other columns are left out.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        each, "page_id long, url string, text string, n_chars long"
    )
