"""Main text of web pages by text-to-tag ratios over parser events.

The standard library's streaming parser is read once; a line is the text inside
one block element, with the number of tags met in it.  The ratio of text to
tags of the lines is smoothed by a Gaussian, and lines above one standard
deviation seed clusters.  Each cluster counts, with the other lines of its
containers at its edges and what lies between two clusters of one container.
Where a page marks articles (``article``, ``main`` or their roles) and they hold
at least half of the clusters' text, their lines are the content, siblings
included; else the clusters are, with the marked articles that they touch.
Menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are left out
wherever they stand, by element, role and words of class and id.

Defined cases: null or empty html gives an empty text; a page without a line
of text gives an empty text; a page whose lines are all alike keeps all of
them; unclosed and crossing tags are closed by the nearest open element of the
same name, an end without a start is none; a tag, comment or quote that is never
closed takes the rest of the page, as in browsers; a ``header`` in ``main`` is
the page's if an ``article`` is in it too, else it is the text's own; a page of
any length takes time in proportion, however its tags nest and whether they
end; repeated rows are extracted alike.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
SKIP = frozenset("nav aside form script style template noscript iframe object svg canvas select button textarea head title dialog menu search".split())
CONTAINER = frozenset("body div section table".split())
WALLS = frozenset(("article", "main", "body"))
PAGE_EDGE = frozenset(("header", "footer"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class and id that name something other than the article.
NAMES = (
    r"nav|navbar|navigation|menu|footer|sidebar|side|aside|ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notice|notification|"
    r"alert|popup|modal|newsletter|subscribe|subscription|comments?|commentlist|respond|replies|disqus|share|sharing|social|breadcrumbs?|pagination|related|recommended|toolbar|widget|skip-?link"
)
FURNITURE = r"bar|box|buttons?|links?|posts?|articles?|stories|list|section|form|slot|unit|container|wrapper|block|area|panel|signup|banner|notice|popup|widgets?|icons?|thread"
#: Outside an article one part of a name is enough.
OUTSIDE = re.compile(rf"(?:^|[\s_-])(?:{NAMES}|header)(?:$|[\s_-])", re.IGNORECASE)
#: Inside, "post-header", "related-work" or "share-price" name the article's own parts: the whole name has to be one of furniture.
INSIDE = re.compile(rf"(?:^|\s)(?:(?:post|article|entry|page|site|user|reader)[_-])?(?:{NAMES})(?:[_-](?:{FURNITURE}))*(?:$|\s)", re.IGNORECASE)
CLOSES_P = BLOCK - {"body", "html"}
SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Collects (text, tags, article or 0, container) of each block in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.stack: list[tuple[str, bool, int]] = []  # name, left out, article
        self.open: dict[str, list[int]] = {}  # where the open elements of a name stand in the stack
        self.walls: list[int] = []  # where articles and bodies do
        self.mains: set[int] = set()  # articles that a main element marks, and those with an article element in them
        self.holders: set[int] = set()
        self.parts: list[str] = []
        self.tags = 0
        self.skip, self.article, self.articles = False, 0, 0
        self.containers: list[int] = []  # open containers, by number
        self.opened, self.bodies = 0, {0}
        self.last: dict[int, int] = {}  # the last container opened inside a closed one

    def end_line(self):
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((text, self.tags, self.article, self.containers[-1] if self.containers else 0))
            self.parts = []
            self.tags = 0

    def outside(self, tag: str, attrs) -> bool:
        if tag in SKIP:
            return True
        if tag in PAGE_EDGE and not self.article:
            return True
        if tag == "footer":
            return True
        for name, value in attrs:
            if value and (name in ("class", "id") and tag not in ("body", "html", "article", "main") and (INSIDE if self.article else OUTSIDE).search(value) or name == "role" and value.lower() in ROLES):
                return True
            if value and name in ("class", "id") and tag == "article" and "comment" in value.lower():
                return True
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
        return False

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
            if tag in CLOSES_P and self.stack and self.stack[-1][0] == "p":
                self.leave(len(self.stack) - 1)
            elif tag in CLOSES_P and any(s[0] == "p" for s in self.stack[-3:]):
                self.handle_endtag("p")
        if tag in VOID:
            if tag == "br" and not self.skip:
                self.parts.append(" ")
            return
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in WALLS:
            self.walls.append(len(self.stack))
        self.stack.append((tag, self.skip, self.article))
        if tag in CONTAINER:
            self.opened += 1
            self.containers.append(self.opened)
            if tag == "body":
                self.bodies.add(self.opened)
        if not self.skip:
            self.skip = self.outside(tag, attrs)
            if not self.skip and tag == "article" and abs(self.article) in self.mains:
                self.holders.add(abs(self.article))
            if not self.skip and tag == "header" and self.article in self.mains and not self.open.get("article"):
                self.article = -self.article  # kept apart until it is known whether the main element holds an article
            if not self.skip and not self.article and (tag in ("article", "main") or ("role", "main") in attrs or ("role", "article") in attrs):
                self.articles += 1
                self.article = self.articles
                if tag == "main" or ("role", "main") in attrs:
                    self.mains.add(self.article)

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        elif tag == "br" and not self.skip:
            self.parts.append(" ")

    def leave(self, at: int):
        self.end_line()
        self.skip, self.article = self.stack[at][1], self.stack[at][2]
        self.drop(at)

    def drop(self, at: int):
        """Closes what is open from this place of the stack on."""
        while len(self.stack) > at:
            name = self.stack.pop()[0]
            self.open[name].pop()
            if name in WALLS:
                self.walls.pop()
            if name in CONTAINER:
                self.last[self.containers.pop()] = self.opened

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        places = self.open.get(tag)
        if not places or tag not in WALLS and tag != "html" and self.walls and self.walls[-1] > places[-1]:
            return  # an end without a start, or without one inside the article
        at = places[-1]
        _, skip, article = self.stack[at]
        if tag not in BLOCK and skip == self.skip and article == self.article:
            self.drop(at)
        else:
            self.leave(at)

    def finish(self):
        """The end of the page closes what is open."""
        HTMLParser.close(self)
        self.end_line()
        self.lines = [(text, tags, abs(article), container) for text, tags, article, container in self.lines if article >= 0 or -article not in self.holders]

    def closed(self, end: int) -> int:
        """Where a construct ends; what doesn't end takes all that follows, so it is looked at once."""
        return end if end >= 0 else len(self.rawdata)

    def parse_starttag(self, i):
        return self.closed(super().parse_starttag(i))

    def parse_endtag(self, i):
        return self.closed(super().parse_endtag(i))

    def parse_comment(self, i, report=True):
        return self.closed(super().parse_comment(i, report))

    def parse_pi(self, i):
        return self.closed(super().parse_pi(i))

    def parse_html_declaration(self, i):
        try:
            return self.closed(super().parse_html_declaration(i))
        except AssertionError:  # a section of another kind is a comment
            return self.closed(self.parse_bogus_comment(i))

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def smoothed(ratios: np.ndarray, width: float) -> np.ndarray:
    """Gaussian smoothing; the kernel reaches three widths."""
    reach = int(3 * width)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def within(lines, containers: set[int], parser: Lines) -> bool:
    """Whether every line lies in one of the containers, which are nested or apart."""
    starts, ends = [], []
    for c in sorted(containers):
        if not ends or c > ends[-1]:
            starts.append(c)
            ends.append(parser.last.get(c, parser.opened))
    places = [bisect_right(starts, line[3]) - 1 for line in lines]
    return all(k >= 0 and line[3] <= ends[k] for k, line in zip(places, lines))


def content_lines(parser: Lines, width: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Which lines threshold clustering seeds, and which it selects with their surroundings."""
    lines = parser.lines
    ratios = np.array([len(t) / max(1, tags) for t, tags, _, _ in lines])
    seeds = smoothed(ratios, width) >= ratios.std()
    if not seeds.any():
        return np.ones(len(lines), bool), np.ones(len(lines), bool)
    edges = np.flatnonzero(np.diff(np.r_[False, seeds, False].astype(int)))
    clusters = [[a, z] for a, z in zip(edges[::2].tolist(), edges[1::2].tolist())]
    joined = [clusters[0]]
    for a, z in clusters[1:]:  # short lines between long ones belong to the text
        if a - joined[-1][1] <= 3:
            joined[-1][1] = z
        else:
            joined.append([a, z])
    chosen = np.zeros(len(lines), bool)
    before, end = set(), 0
    for first, stop in joined:
        inside = {line[3] for line in lines[first:stop]}
        shared = before & inside - parser.bodies
        if shared and within(lines[end:first], shared, parser):
            first = end
        while first > end and lines[first - 1][3] in inside:  # titles and lists at the edges
            first -= 1
        end = stop
        while end < len(lines) and not seeds[end] and lines[end][3] in inside:
            end += 1
        chosen[first:end] = True
        before = inside
    return seeds, chosen


def main_text(html: str | None, width: float = 1.0) -> str:
    """The blocks of the main text, two line ends between them."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.finish()
    lines = parser.lines
    if not lines:
        return ""
    seeds, chosen = content_lines(parser, width)
    article = np.array([line[2] for line in lines])
    size = np.array([len(line[0]) for line in lines])
    if 2 * size[seeds & (article > 0)].sum() >= size[seeds].sum():
        chosen = article > 0
    else:
        chosen |= np.isin(article, article[seeds & (article > 0)])
    return "\n\n".join(line[0] for line, take in zip(lines, chosen.tolist()) if take)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", width: float = 1.0) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""

    def batches(it):
        for b in it:
            texts = [main_text(h, width) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.select(F.col(page_id)).schema[0].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(batches, f"page_id {kind}, url string, text string, n_chars long")
