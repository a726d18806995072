"""Main text of web pages: parser events become lines, whose text-to-tag ratios choose the content region."""

from __future__ import annotations

import math
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# ---- fixed values: elements and names as pages use them ----
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
SKIPPED = frozenset(
    "head script style noscript template nav footer aside form button select textarea option svg math iframe object canvas audio video dialog menu".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    """ad ads adv advert advertisement adverts advertising adsense adbox adslot banner sponsor sponsored sponsors promo promotion promoted
    cookie cookies consent gdpr notice notices notification notifications alert disclaimer popup modal overlay paywall
    comment comments commentlist respond reply replies disqus discussion reviews
    sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc
    footer masthead topbar toolbar header share sharing social related recommended recommendations newsletter subscribe subscription signup login search widget widgets skip""".split()
)
#: Of the names above, those that an article element inside them does not refute.
READERS = frozenset("comment comments commentlist respond reply replies disqus discussion reviews related recommended recommendations sidebar aside widget widgets".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# ---- end of fixed values ----

KERNEL = [math.exp(-(x * x) / 2.0) for x in range(-3, 4)]


class Line:
    """A block of text: its words, the tags inside it, how much of it links hold, and the elements around it."""

    __slots__ = ("parts", "tags", "linked", "around")

    def __init__(self, around: tuple):
        self.parts: list[str] = []
        self.tags, self.linked, self.around = 1, 0, around


class Element:
    __slots__ = ("name", "skip", "soft", "main")

    def __init__(self, name: str, skip: bool, soft: bool, main: bool):
        self.name, self.skip, self.soft, self.main = name, skip, soft, main


def words_of(value: str | None) -> set[str]:
    out, word = set(), ""
    for c in (value or "").lower() + " ":
        if c.isalnum():
            word += c
        else:
            out.add(word)
            word = ""
    return out


class Lines(HTMLParser):
    """The lines of a page outside menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        self.lines: list[Line] = []
        self.line: Line | None = None
        self.links = 0
        self.skipping = 0

    def _end_line(self) -> None:
        self.line = None

    def _push(self, element: Element) -> None:
        self.open.append(element)
        self.skipping += element.skip

    def _pop(self) -> None:
        self.skipping -= self.open.pop().skip

    def _close(self, names: set[str] | frozenset[str], barriers: set[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].name in names:
                while len(self.open) > i:
                    self._pop()
                return
            if self.open[i].name in barriers:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in INLINE or tag in VOID:
            if self.line is not None:
                self.line.tags += 1
                if tag == "br":
                    self.line.parts.append(" ")
                elif tag == "hr":
                    self._end_line()
            self.links += tag == "a"
            return
        self._end_line()
        self.links = 0
        if tag == "body":
            self._close({"head"}, set())
        if tag in CLOSES_P:
            self._close({"p"}, {"td", "th", "li", "div", "article", "section", "main", "blockquote"})
        if tag in PEERS:
            self._close(PEERS[tag], {"ul", "ol", "dl", "table", "select"})
        given = dict(attrs)
        names = words_of(given.get("class")) | words_of(given.get("id"))
        inside = any(e.main for e in self.open)
        main = tag in ("article", "main") or given.get("role") in ("main", "article") or "articleBody" in (given.get("itemprop") or "")
        refuted = bool(names & READERS)
        if main and not refuted:
            # an element that was never closed does not hold an article
            first = next((i for i, e in enumerate(self.open) if e.skip), None)
            if first is not None and not any(e.skip and not e.soft for e in self.open):
                while len(self.open) > first:
                    self._pop()
        named = bool(names & NAMES) and tag not in ("html", "body") and not (main and not refuted)
        header = tag == "header" and not inside
        skip = tag in SKIPPED or named or header or given.get("role") in ROLES or "hidden" in given or (given.get("aria-hidden") or "").lower() == "true"
        soft = skip and tag not in ("head", "script", "style", "noscript", "template") and not refuted and tag != "aside"
        self._push(Element(tag, skip, soft, main and not refuted and not skip))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE and tag in ("svg", "iframe", "object"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE or tag in VOID:
            if tag == "a":
                self.links = max(0, self.links - 1)
            if tag == "br" and self.line is not None:
                self.line.parts.append(" ")
            return
        self._end_line()
        self.links = 0
        barriers = {"article", "main", "body"} if tag in ("p", "li", "div", "span", "section") else set()
        self._close({tag}, barriers - {tag})

    def handle_data(self, data: str) -> None:
        if self.skipping:
            return
        if self.line is None:
            if not data.strip():
                return
            # inside an article, of its own header only headings belong to the text
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].name == "header" and not any(e.name in HEADINGS for e in self.open[i:]):
                    return
            self.line = Line(tuple(self.open))
            self.lines.append(self.line)
        self.line.parts.append(data)
        if self.links:
            self.line.linked += len(data)


def smoothed(values: list[float]) -> list[float]:
    """A Gaussian of one line's width over the ratios; at the ends the weights that exist count."""
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in enumerate(KERNEL, -3):
            if 0 <= i + k < len(values):
                total += w * values[i + k]
                weight += w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """The border between a low and a high cluster of values (two means, started at the extremes)."""
    low, high = min(values), max(values)
    for _ in range(50):
        border = (low + high) / 2
        below, above = [v for v in values if v < border], [v for v in values if v >= border]
        if not below or not above:
            return low
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """Blocks of the main text in page order, joined by an empty line; empty where a page has none.

    1. Parser events cut the page into lines at block elements; known containers of other matter are left out.
    2. Text-to-tag ratios of the lines are smoothed, and the lines above the border of two clusters are content.
    3. The region is the article (or main) element with most content, else the smallest element that holds three fifths of
       all content. All its lines count, short ones too; outside articles, lines that are links alone do not.
    """
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    found = []
    for line in parser.lines:
        text = " ".join("".join(line.parts).split())
        if text:
            found.append((line, text))
    if not found:
        return ""
    ratios = smoothed([len(text) / line.tags for line, text in found])
    border = threshold(ratios)
    mass: dict[Element, int] = {}
    total = 0
    for (line, text), ratio in zip(found, ratios):
        if ratio >= border:
            total += len(text)
            for element in line.around:
                mass[element] = mass.get(element, 0) + len(text)
    mains = [e for e in mass if e.main]
    region = None
    if mains:
        # the innermost of those with most content
        region = max(mains, key=lambda e: (mass[e], max(line.around.index(e) for line, _ in found if e in line.around)))
        inner = [e for e in mains if e is not region and mass[e] * 5 >= mass[region] * 3 and any(region in line.around and e in line.around for line, _ in found)]
        region = max(inner, key=lambda e: mass[e]) if inner else region
    else:
        for line, _ in found:
            for element in line.around:
                if mass.get(element, 0) * 5 >= total * 3 and (region is None or mass[element] < mass[region] or (mass[element] == mass[region] and region in line.around and line.around.index(element) > line.around.index(region))) and element.name not in HEADINGS and element.name != "p":
                    region = element
    kept = []
    for line, text in found:
        if region is not None and region not in line.around:
            continue
        if not mains and line.linked * 5 >= len("".join(line.parts)) * 4:
            continue
        kept.append(text)
    return "\n\n".join(kept)


def page_texts(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points of the text).

    Whole pages are read; null and empty ones give an empty text. Markup may be broken: unclosed elements end with the
    element around them, and an article inside a container that was never closed still counts. Repeated rows and nulls in
    any column pass through; other columns are ignored; an empty table gives no rows. There is no shuffle.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
