"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element, with a blank line between
two. Every line has a length: its characters, or 0 if it is mostly links; lines
in an element that holds no article are left out. The sums of the lengths over
sliding windows of lines surge where the article begins and dive to 0 where it
ends; the lines of length over 0 between surges and dives are kept.

An element whose name or kind speaks against the article is a box. The lines of
a box, of the boxes of equal names beside it, and those that stand in no box,
each within and without the element that marks the article, are distributions of
their own, so an advert does not part the paragraphs around it. One of them
gives the text: the one with most characters in its surges, where a name or a
missing mark decides only between comparable masses. A form, share bar or
widget needs four times the characters of what it is held against, a menu or
sidebar sixteen times, an advert or a request more than any article has. So a
page whose whole article stands in a form or in a box with a telling name still
gives it, and the advert within that box stays out.

A surge begins at a line that bears its part of the sum, with the lines right
above it and a main heading within the window. After the first surge a third of
its sum is enough for a later one.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorline.llm.common import fresh_name

#: Lines in a window (three blocks and the blank lines between them), and characters in a window where a surge begins.
WINDOW = 5
SURGE = 86
#: What a missing mark divides a mass by where another part of the page is marked as the article.
UNMARKED = 256

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title|select|object|canvas|audio|video)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)[^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PIECES = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

#: Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDERS = frozenset("article main section div body table ul ol dl nav aside header footer form blockquote td".split())
#: Elements, roles and name parts that hold no article text, and those that only speak against it.
_NO_TEXT = frozenset("head nav footer aside button menu dialog".split())
_NO_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
_REPLIES = frozenset("comment comments disqus replies respond".split())
_DOUBTFUL_TAGS = frozenset("form fieldset".split())
_PAID = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login".split())
_LAYOUT = frozenset("sidebar menu nav navbar navigation breadcrumb breadcrumbs footer foot related recommended recommendations pagination pager search copyright toc skip".split())
_DOUBTFUL = frozenset("promo promotion banner notice notices overlay header masthead topbar share sharing social widget widgets toolbar disclaimer alert".split())
#: Grades of an element, and of each what its mass is divided by and the fewest characters that count as an article.
_GOOD, _NAMED, _PART, _ASKS, _OUT = range(5)
_WEIGHT = {_GOOD: 1, _NAMED: 4, _PART: 16, _ASKS: 256}
_LEAST = {_GOOD: 1, _NAMED: 4, _PART: 32, _ASKS: 1024}


def _grade(tag: str, attrs: str, in_article: bool) -> int:
    """What the markup of an element says: _OUT if it holds no article text, _GOOD if
    nothing speaks against it."""
    if tag in _NO_TEXT or tag == "header" and not in_article:
        return _OUT
    found = _NAMED if tag in _DOUBTFUL_TAGS else _GOOD
    if not attrs or tag in ("html", "body", "article", "main") and "comment" not in attrs.lower():
        return found
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            parts = {p.lower() for p in _PIECES.findall(value)}
            if parts & _REPLIES:
                return _OUT
            if not (in_article and tag in ("h1", "h2", "p")):
                found = max([found, *(g for g, names in ((_ASKS, _PAID), (_PART, _LAYOUT), (_NAMED, _DOUBTFUL)) if parts & names)])
        elif name == "role" and value.lower() in _NO_ROLE or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return _OUT
        elif name == "itemprop" and value.lower() == "comment" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return _OUT
    return found


class Line(NamedTuple):
    """A line of a page: its text, the grade and number of its box, whether it lies in an
    element that marks the article, characters of link text, whether it is a main heading."""

    text: str
    grade: int
    box: int
    inside: bool
    linked: int
    head: bool


def page_lines(page: str) -> list[Line]:
    """Lines of a page in order. Boxes of one name in one box share their number; 0 is no box."""
    lines: list[Line] = []
    stack: list[tuple[str, int, int, bool]] = []  # tag, grade, box, in article
    opened: dict[str, int] = {}
    boxes: dict[tuple, int] = {}
    grade, box, inside = _GOOD, 0, False
    links, parts, linked = 0, [], 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append(Line(text, grade, box, inside, linked, bool(opened.get("h1") or opened.get("h2"))))
            parts, linked = [], 0

    def pop() -> str:
        nonlocal grade, box, inside, links
        tag = stack.pop()[0]
        opened[tag] -= 1
        links -= tag == "a"
        grade, box, inside = stack[-1][1:] if stack else (_GOOD, 0, False)
        return tag

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br" or tag == "hr":
            parts.append(" ")
        if tag in _VOID:
            continue
        if tag not in _INLINE:
            close()
        if m["end"] or m["end2"]:
            if opened.get(tag):
                if any(t not in _INLINE for t in (tag, stack[-1][0])):
                    close()
                while pop() != tag:
                    pass
            continue
        attrs = m["attrs"] or ""
        if tag in _CLOSES:
            while stack and stack[-1][0] not in _HOLDERS and any(opened.get(t) for t in _CLOSES[tag]):
                pop()
        own = _grade(tag, attrs, inside)
        new_box = boxes.setdefault((box, tag, attrs), len(boxes) + 1) if _GOOD < own < _OUT else box
        inside = inside or tag in ("article", "main") and max(grade, own) < _OUT or 'itemprop="articleBody"' in attrs
        if own > grade or new_box != box:
            close()
        grade, box = max(grade, own), new_box
        if not attrs.endswith("/"):
            stack.append((tag, grade, box, inside))
            opened[tag] = opened.get(tag, 0) + 1
            links += tag == "a"
        elif stack:
            grade, box, inside = stack[-1][1:]
        else:
            grade, box, inside = _GOOD, 0, False
    add(page[at:])
    close()
    return lines


def _windows(size: list[float]) -> list[float]:
    return [sum(size[k : k + WINDOW]) for k in range(len(size))]


def _surges(size: list[float], heads: list[bool], least: float, later: float) -> list[int]:
    """Places of the lines between surges and dives of one distribution, blank lines left out."""
    total, kept, at, end = _windows(size), [], 0, 0  # the next window, the end of the last surge
    while at < len(size):
        if total[at] < least:
            at += 1
            continue
        begin = next(k for k in range(at, at + WINDOW) if size[k] * WINDOW >= least)
        begin = min([begin, *(k for k in range(max(end, begin - WINDOW + 1), begin) if heads[k] and size[k])])
        while begin > end + 1 and size[begin - 2]:
            begin -= 2
        end = max(begin, at)
        while end < len(size) and total[end]:
            end += 1
        kept += [k for k in range(begin, end) if size[k]]
        at, least = end, later
    return kept


def main_text(page: str | None) -> str:
    """Article text of a page, its blocks joined by one space; empty if there is none."""
    lines = page_lines(page or "")
    marked = any(x.inside and x.grade < _OUT for x in lines)
    parts: dict[tuple[int, bool], list[int]] = {}
    for k, x in enumerate(lines):
        if x.grade < _OUT:
            parts.setdefault((x.box, x.inside), []).append(k)
    best, found = 0.0, []
    for (_, inside), mine in parts.items():
        size, heads = [0.0] * (2 * len(mine)), [False] * (2 * len(mine))
        for j, k in enumerate(mine):
            x = lines[k]
            size[2 * j] = 0.0 if 2 * x.linked > len(x.text) and not inside else float(len(x.text))
            heads[2 * j] = x.head
        least = min(SURGE, max(_windows(size)))
        kept = [mine[j // 2] for j in _surges(size, heads, least, min(least, SURGE / 3))] if least else []
        mass, grade = sum(len(lines[k].text) for k in kept), lines[mine[0]].grade
        worth = mass / _WEIGHT[grade] / (UNMARKED if marked and not inside else 1)
        if mass >= _LEAST[grade] and worth > best:
            best, found = worth, kept
    return " ".join(lines[k].text for k in found)


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add ``text_col string`` with the main text of the whole page.

    Null, empty and pages without an article give the empty text. Repeated rows
    stay; an existing ``text_col`` is replaced. One pass, no shuffle; a page is
    the largest unit in memory.
    """
    rest = [c for c in df.columns if c.lower() != text_col.lower()]
    given = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{html_col}`").cast("string").alias(fresh_name(df, "page")))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(text_col, T.StringType())])
    n = len(rest)

    def run(batches):
        for batch in batches:
            made = pa.array([main_text(p.as_py()) for p in batch.column(n)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], made], names=[*rest, text_col])

    return given.mapInArrow(run, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    made = extract(pages.select("page_id", "url", "html"))
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
