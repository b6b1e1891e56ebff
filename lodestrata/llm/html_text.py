"""Main text of web pages from text-to-tag ratios.

The standard library's parser streams events; every block element ends a line.  A
line's ratio is its number of text characters over its number of tags (at least
one).  The ratios are smoothed with a Gaussian over neighbouring lines, and lines
at or above a threshold, a share of the smoothed ratios' standard deviation,
cluster into content regions.  A line below it belongs to the region when it lies
between two lines of the region, as one-word paragraphs do, or is a heading right
above one.  An article or main element neither adds lines of its own nor hides those
outside it: it is a weight on the ratios of its lines once one of them has reached
the threshold without it and by its own ratio, a gap between two of its content lines
is closed across what is set apart in it, and a gap that leaves or enters it stays open.

Lines inside menus, headers of the page, footers, sidebars, notices, adverts,
forms, comments and the like (by element, role, class or id) are never content, take
no part in the smoothing and break regions outside articles; scripts, styles and
comments yield no line.  Classes and ids never set html, body, main or an article
apart, and another container only when it is not the body of the page under such a
name (``has-sidebar``): one that holds more than half of the text that is not apart
already, less than half of it in links, stays.  Where it is named for comments it must
hold a first level heading as well, and where only text outside of it is in an article,
more than four fifths of the text.

Defined cases: a null or empty html gives an empty text; unclosed elements end with
the page, and a paragraph ends where the next block starts; broken markup is read as
far as the parser can; a page without any line gives an empty text; a line exactly at the threshold is
content; elements may nest to any depth, pages be of any length; repeated rows
give equal results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm.arrow_groups import lean

#: Elements that end a line.
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never content.
_SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select option textarea button".split())
_APART = frozenset("nav footer aside form menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social comment comments disqus replies respond related recommended recommendations pagination pager "
    "widget tags copyright".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of readers' comments, which can outweigh the article.
_DISCUSSION = frozenset("comment comments disqus replies respond".split())
#: Elements that class and id never set apart.
_BODIES = frozenset("html body main article".split())
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
#: Elements that a start of these closes when open.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SIGMA = 1.0
SHARE = 0.25
WEIGHT = 4.0


class _Lines(HTMLParser):
    """Collects lines: text, number of tags, whether apart, number of the innermost article (0: none), whether a heading.

    ``boxes`` has [parent, text characters, characters in links, whether a first
    level heading is inside, whether named for comments] of each container with a
    name of ``_NAMES``; whether it is apart is known when the page has ended.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int, bool]] = []
        self.open: list[tuple[str, bool, bool, int, int]] = []
        self.boxes: list[list] = []
        #: Of each line: the innermost container of ``boxes`` (-1: none) and its characters in links.
        self.inside: list[tuple[int, int]] = []
        self.linked = 0
        self.text: list[str] = []
        self.tags = 0
        self.articles = 0

    def _state(self) -> tuple[bool, bool, int, int]:
        return self.open[-1][1:] if self.open else (False, False, 0, -1)

    def _end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            _, apart, article, box = self._state()
            self.lines.append((text, self.tags, apart, article, any(tag in _HEADINGS for tag, *_ in self.open)))
            self.inside.append((box, min(self.linked, len(text))))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCKS:
            self._end_line()
        self.tags += 1
        if tag in _VOID:
            return
        if tag in _CLOSES:
            self._close(_CLOSES[tag], "ul ol table dl select".split())
        elif tag in _BLOCKS:
            self._close(("p",), ())
        silent, apart, article, box = self._state()
        silent = silent or tag in _SILENT
        if tag in ("article", "main"):
            self.articles += 1
            article = self.articles
        apart = apart or tag in _APART or self._role_apart(attrs) or (tag == "header" and not article)
        if not apart and tag not in _BODIES and (names := self._names(attrs)):
            self.boxes.append([box, 0, 0, False, bool(names & _DISCUSSION)])
            box = len(self.boxes) - 1
        if tag == "h1" and not apart:
            above = box
            while above >= 0:
                self.boxes[above][3] = True
                above = self.boxes[above][0]
        self.open.append((tag, silent, apart, article, box))

    @staticmethod
    def _role_apart(attrs: list) -> bool:
        for name, value in attrs:
            if name == "role" and value and value.strip().lower() in _ROLES:
                return True
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
        return False

    @staticmethod
    def _names(attrs: list) -> set[str]:
        return {part for name, value in attrs if name in ("class", "id") and value for part in _PARTS.split(value.lower()) if part in _NAMES}

    def _close(self, names, stops) -> None:
        """Close an open element of ``names`` above which no element of ``stops`` is open."""
        for at in range(len(self.open) - 1, -1, -1):
            tag = self.open[at][0]
            if tag in names:
                self._end_line()
                del self.open[at:]
                return
            if tag in stops or tag in _BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self._end_line()
        self.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                return

    def handle_data(self, data: str) -> None:
        if not self._state()[0]:
            self.text.append(data)
            if any(entry[0] == "a" for entry in self.open):
                self.linked += len(data.strip())

    def finish(self) -> list[tuple[str, int, bool, int, bool]]:
        self.close()
        self._end_line()
        if self.boxes:
            apart = self._boxes_apart()
            self.lines = [(text, tags, gone or box >= 0 and apart[box], *rest) for (text, tags, gone, *rest), (box, _) in zip(self.lines, self.inside)]
        return self.lines

    def _boxes_apart(self) -> list[bool]:
        """Whether each container, or one around it, is apart."""
        def chain(box: int) -> Iterator[int]:
            while box >= 0:
                yield box
                box = self.boxes[box][0]

        def measure(apart: list[bool]) -> int:
            total = 0
            for box in self.boxes:
                box[1] = box[2] = 0
            for (text, _, gone, *_), (box, linked) in zip(self.lines, self.inside):
                if gone or any(apart[b] for b in chain(box)):
                    continue
                total += len(text)
                for b in chain(box):
                    self.boxes[b][1] += len(text)
                    self.boxes[b][2] += linked
            return total

        measure([False] * len(self.boxes))
        # What is apart whatever its share counts for no other container.
        sure = [2 * linked >= chars or discussion and not heading for _, chars, linked, heading, discussion in self.boxes]
        total = measure(sure)
        used = [box for (_, _, gone, article, _), (box, _) in zip(self.lines, self.inside) if article and not gone]
        free = any(box < 0 for box in used)
        around = {b for box in used for b in chain(box)}
        small = [
            gone or (5 * chars <= 4 * total if free and k not in around else 2 * chars <= total)
            for k, (gone, (_, chars, *_)) in enumerate(zip(sure, self.boxes))
        ]
        return [any(small[b] for b in chain(k)) for k in range(len(self.boxes))]


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is renormalised."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    lines = parser.finish()
    usable = [i for i, (_, _, apart, *_) in enumerate(lines) if not apart]
    if not usable:
        return ""
    ratios = [len(lines[i][0]) / max(1, lines[i][1]) for i in usable]
    smooth = smoothed(ratios)
    mean = sum(smooth) / len(smooth)
    threshold = SHARE * math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    # A line that only its neighbours lift does not choose its article.
    chosen = {lines[i][3] for i, x, own in zip(usable, smooth, ratios) if min(x, own) >= threshold} - {0}
    core = [k for k, x in enumerate(smooth) if x * (WEIGHT if lines[usable[k]][3] in chosen else 1.0) >= threshold]
    taken = set(core)
    for left, right in zip(core, core[1:]):
        article = lines[usable[left]][3]
        # Apart lines break a region, unless they lie inside its article.
        if article == lines[usable[right]][3] and (article or usable[right] - usable[left] == right - left):
            taken.update(k for k in range(left + 1, right) if lines[usable[k]][3] == article)
    for k in range(len(usable) - 2, -1, -1):
        here, below = lines[usable[k]], lines[usable[k + 1]]
        if here[4] and k + 1 in taken and here[3] == below[3]:
            taken.add(k)
    return " ".join(lines[usable[k]][0] for k in sorted(taken))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row; nothing is shuffled."""
    base = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    return base.mapInArrow(lean(_extract), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
