"""Main text of web pages by line-block distribution.

A page is read once, left to right, into lines (text between block-level tags). A line weighs its
characters outside links; those in links count only where they are prose (more than LINK_PROSE of
them). Markup is a weight too: lines of elements that are boilerplate by meaning (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments, scripts, styles, hidden elements) weigh
nothing and are never text, and where some article or main element holds text, lines outside such
elements weigh nothing.

Weights are summed over windows of WINDOW lines, for each article or main element on its own (else for the
page). A surge is a window that reaches a threshold, a dive is where the windows fall to nothing; a
region reaches from the dive before a surge to the dive after it, so a title and short paragraphs
beside a surge belong to its region. The threshold is half the window in which the page's median
character stands, SURGE_CHARS at most, so that no long paragraph raises it for others. Regions are
kept. An article or main element that holds lines of links and no surge goes (it leads to other
pages); of any other, all between the dive before its first text and the dive after its last one is kept
(a list of links between paragraphs too), and links below a heading that ends it. So the
distribution decides about links and scattered short lines, markup about what it names.

Nulls and pages without text give "" with n_chars 0. Repeated rows give a row each, an empty table
an empty result; nothing depends on the rows' order. Of equal windows none is preferred: each is
a surge or not. Pages of any length are read whole, in linear time. Only page_id, url and html are read, so
other columns may have any names; unclosed tags, comments and quotes end at the page's end.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Characters that WINDOW lines must weigh to be a surge, whatever the page's other windows weigh.
SURGE_CHARS = 60
#: Characters up to which a line of links alone is a menu's entry, a headline or a button, and weighs nothing.
LINK_PROSE = 100

#: HTML elements by meaning.
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr
    math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot munder mover munderover mtable mtr mtd mspace mpadded menclose semantics""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Skipped whole: up to the first end tag, and up to the end tag that closes the first start tag.
RAW = frozenset("script style textarea title noscript iframe noframes xmp annotation".split())
NESTED = frozenset("svg template select object canvas audio video".split())
DROPPED = frozenset("nav footer aside form button dialog menu fieldset datalist head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: Elements whose class or id may mark them as boilerplate; sections, articles, figures, words, headings, paragraphs and items aren't, but for a section whose whole class name does.
CONTAINERS = frozenset("div ul ol dl table center".split())
#: Names that mean boilerplate as a name's last word, whatever stands before.
STRONG = frozenset(
    """advert adverts advertisement advertising adsbygoogle sponsored nav navbar navigation menubar breadcrumb breadcrumbs pagination pager toolbar topbar masthead
    sidebar sidebars footer gdpr newsletter commentlist disqus sharebar""".split()
)
#: Names that mean it only if every other word of the name is one of these, of STRONG or of LAYOUT.
WEAK = frozenset(
    """ad ads adv sponsor promo promotion banner menu widget widgets cookie cookies consent popup modal overlay comment comments sharing social
    aside related recommended recommendations trending popular notice notices alert paywall form share subscribe subscription signup login replies respond""".split()
)
#: Words that say where or how something stands.
LAYOUT = frozenset(
    """site page main global content article post entry story left right top bottom upper lower inner outer primary secondary header list lists box boxes bar wrapper wrap container area
    section block row column col slot unit group links link icons icon buttons button title item items thread text body panel card cards stories posts articles most recent latest
    you may also like js wp""".split()
)
#: Names that mark it as the whole name only.
WHOLE = frozenset("copyright legal hidden search skip skiplink".split())
#: First words of names that speak of the text itself, whatever follows, and of its own header.
OWN = frozenset("entry post article story content".split())

_TOKEN = re.compile(r"""<!--|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|$)|<[a-zA-Z/][^>]*$""", re.S)
_ATTR = re.compile(r"""([^\s=/"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HEADING = re.compile(r"\s*(?:<(?:div|a|span|header)\b[^<>]*>\s*){0,3}<h[1-6]\b[^<>]*>(.{0,300}?)</h[1-6]", re.S | re.I)


def _marks(token: str, in_article: bool) -> bool:
    """Whether a class or id name marks boilerplate."""
    parts = [p.lower() for p in _PART.findall(token)]
    if not parts:
        return False
    last, whole = parts[-1], "".join(parts)
    if last == "header":
        return not in_article and parts[0] not in OWN
    if last in STRONG or whole in WHOLE or whole in STRONG or whole in WEAK:
        return True
    known = [p in WEAK or p in STRONG for p in parts]
    return any(known) and all(k or p in LAYOUT or len(p) == 1 for k, p in zip(known, parts, strict=True))


def _slug(text: str) -> str:
    return "-".join(re.findall(r"\w+", unescape(re.sub(r"<[^>]*>", "", text)).lower()))


def _names_heading(value: str, html: str, at: int) -> bool:
    """Whether an id is the slug of the heading that its element starts with: a generated anchor."""
    m = _HEADING.match(html, at)
    return bool(m) and _slug(m[1]) == _slug(value)


def _boilerplate(name: str, attrs: str, in_article: bool, html: str, at: int) -> bool:
    """Whether an element, whose start tag ends at `at`, is boilerplate by its name or attributes."""
    if name in DROPPED or name == "header" and not in_article:
        return True
    if not attrs or attrs.isspace() or name in ("html", "body", "main"):
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            if name in CONTAINERS and any(_marks(t, in_article) for t in value.split()) and not (key == "id" and _names_heading(value, html, at)):
                return True
            if key == "class" and name == "section" and any(t.lower() in WEAK or t.lower() in STRONG for t in value.split()):
                return True
        elif key == "role":
            if value.lower() in ROLES:
                return True
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _end_of(html: str, name: str, at: int) -> int:
    """Where an element that is skipped whole and started before `at` ends."""
    if name in RAW:
        close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
        return len(html) if close is None else close.end()
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).finditer(html, at):
        depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
        if not depth:
            return m.end()
    return len(html)


class Line(NamedTuple):
    """A line's text ("" if it is boilerplate), characters outside and in links, the article or main that holds it, and whether it is a heading's."""

    text: str
    plain: int
    linked: int
    article: int | None
    heading: bool

    @property
    def weight(self) -> int:
        return self.plain + self.linked if self.linked > LINK_PROSE else self.plain


def lines_of(html: str) -> list[Line]:
    """The page's lines in order."""
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, whether it is dropped, whether it is an article
    inside: list[int] = []  # numbers of the open articles
    dropped = articles = links = plain = linked = at = 0
    passed = False  # whether boilerplate text was met since the last line
    size = len(html)

    def flush() -> None:
        nonlocal plain, linked, passed
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Line(text, plain, linked, inside[-1] if inside else None, any(len(x[0]) == 2 and x[0][0] == "h" and x[0][1].isdigit() for x in stack)))
            parts.clear()
        elif passed:
            out.append(Line("", 0, 0, inside[-1] if inside else None, False))
        plain = linked = 0
        passed = False

    def leave(name: str, gone: bool, scope: bool) -> None:
        nonlocal dropped, links
        dropped -= gone
        links -= name == "a"
        if scope:
            inside.pop()

    while at < size:
        m = _TOKEN.search(html, at)
        end = m.start() if m else size
        if end > at:
            piece = html[at:end]
            if dropped:
                passed = passed or not piece.isspace()
            else:
                parts.append(piece)
                if not piece.isspace():
                    plain += 0 if links else len(piece)
                    linked += len(piece) if links else 0
        if not m:
            break
        at = m.end()
        if m[0] == "<!--":
            close = html.find("-->", at)
            at = size if close < 0 else close + 3
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        whole = name in RAW or name in NESTED
        if name not in INLINE and not whole:  # what is skipped whole doesn't break the line it stands in
            flush()
        elif name == "br" and not dropped:
            parts.append(" ")
        if m[1] or m[4]:
            if any(x[0] == name for x in stack):
                while stack:
                    top = stack.pop()
                    leave(*top)
                    if top[0] == name:
                        break
            continue
        attrs = m[3] or m[6] or ""
        if whole:
            if not attrs.rstrip().endswith("/"):
                at = _end_of(html, name, at)
            continue
        if name in VOID:
            continue
        if name == "p":  # a paragraph ends an open one; formatting left open in it ends with it
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] not in INLINE), -1)
            if depth >= 0 and stack[depth][0] == "p":
                for top in stack[depth:]:
                    leave(*top)
                del stack[depth:]
        gone = bool(dropped) or _boilerplate(name, attrs, bool(inside), html, at)
        scope = name in ("article", "main")
        stack.append((name, gone, scope))
        dropped += gone
        if scope:
            inside.append(articles)
            articles += 1
        links += name == "a"
    flush()
    return out


def windows(weights: list[int]) -> list[int]:
    """Sums of each WINDOW lines from each line on."""
    return [sum(weights[i : i + WINDOW]) for i in range(len(weights))]


def surges_to_dives(weights: list[int], surge: float) -> list[tuple[int, int]]:
    """The regions of lines, from dive to dive, whose windows reach `surge` somewhere, without weightless lines at their ends."""
    sums = windows(weights)
    out, at = [], 0
    while at < len(sums):
        if not sums[at]:
            at += 1
            continue
        end = at
        while end < len(sums) and sums[end]:
            end += 1
        if max(sums[at:end]) >= surge:
            first, last = at, end
            while not weights[first]:
                first += 1
            while not weights[last - 1]:
                last -= 1
            out.append((first, last))
        at = end
    return out


def threshold(stretches: list[list[Line]]) -> float:
    """Half the size of window in which, or in smaller ones, half of the page's text stands; SURGE_CHARS at most."""
    sums = sorted(w for lines in stretches for w in windows([x.weight for x in lines]))
    below = list(accumulate(sums))
    return min(SURGE_CHARS, sums[bisect_left(below, below[-1] / 2)] / 2) if sums else SURGE_CHARS


def main_text(html: str | None) -> str:
    lines = lines_of(html) if html else []
    stretches: dict[int | None, list[Line]] = {}
    for x in lines:
        stretches.setdefault(x.article, []).append(x)
    marked = {k: v for k, v in stretches.items() if k is not None and any(x.weight for x in v)}
    if not marked:
        weights = [x.weight for x in lines]
        return "\n".join(x.text for first, last in surges_to_dives(weights, threshold([lines])) for x in lines[first:last] if x.text)
    surge = threshold(list(marked.values()))
    kept: set[int] = set()
    for own in marked.values():
        weights = [x.weight for x in own]
        if any(x.linked and not x.weight for x in own) and max(windows(weights)) < surge:
            continue  # links with a few words about them: it leads to another page
        found = surges_to_dives(weights, 1)
        first, last = found[0][0], found[-1][1]
        if own[last - 1].heading:
            while last < len(own) and own[last].linked and not own[last].weight:
                last += 1
        kept.update(id(x) for x in own[first:last] if x.text)
    return "\n".join(x.text for x in lines if id(x) in kept)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint")
