"""Main text of web pages by line-block distribution.

Markup is stripped so that every block of text becomes a line; an edge of a
section (a container, or something removed: menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts, styles) leaves a window of blank
lines. A line weighs its characters outside links less those inside. Weights
are summed over sliding windows of lines. A run of lines, between blank
windows, surges where a window's sum is above the floor; the main text reaches
from the first surge point to the last dive point, where sums fall back to
nothing, and what stands between them stays.

On pages that mark their article, lines outside it are blank, each article has
its own surge and dive points, and the floor is the least weight: every run
that is not mostly links surges, so lists of links at either end go, with the
headings that announce them. On other pages the floor is ``SURGE``, points are
sought in each parent container, and short runs of text beside those that
surge stay, headings before the first one included.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import table

#: Lines of a window, and weight that a run's best window needs on pages without an article.
WINDOW_LINES = 3
SURGE = 120

RAW = "script|style|noscript|template|svg|iframe|textarea|title|select|object|canvas|math|audio|video"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)\b(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+(?<=/)>|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</(?P=raw)\s*>|.*\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)",
    re.S | re.I)
ARTICLE = re.compile(r"<(?:article|main)\b", re.I)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LINE_TAGS = HEADINGS | frozenset("p br li tr td th dt dd blockquote pre figcaption hr caption address summary option label".split())
SECTION_TAGS = frozenset(
    "html head body div section article main table ul ol dl figure details fieldset center tbody thead tfoot "
    "nav header footer aside form menu dialog button input".split())
REMOVED_TAGS = frozenset("nav header footer aside form menu dialog button head".split())
NAMED_TAGS = frozenset("div section aside ul ol dl p span table article figure details a center fieldset".split())
#: Words in a container's class, id or role that say it is no main text.
REMOVED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices notification alert popup modal newsletter subscribe subscription signup login sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead toolbar pagination pager share sharing social related recommended recommendations "
    "comment comments commentlist disqus replies reply respond widget search complementary contentinfo form".split())
#: Other words of such a name; a name with any further word (no-sidebar, related-work) says something else.
PLAIN_NAMES = frozenset(
    "site main page global primary secondary top bottom left right upper lower mobile desktop post entry block wp user "
    "list lists item items links link buttons button icons bar box boxes wrapper wrap container inner outer area section region row column col "
    "slot unit posts articles stories text title body content icon overlay message dialog panel group grid card cards thread feed "
    "carousel slider label module holder placeholder google header footer".split())
#: Words that say so as the first or last part of a name, whatever else is in it; as the last part alone.
ENDING_NAMES = frozenset("comment comments disqus ads advert adverts advertisement advertising adsense sponsored promo".split())
LAST_NAMES = frozenset("ad".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus".split())
#: Words that make of a name a statement about something else.
STATE_NAMES = frozenset("no not without with has is hide hidden open opened closed enabled disabled allowed count on off".split())
#: Elements that the next block ends even where they are not closed.
SHORT_TAGS = frozenset("p span a li".split())
VOID_TAGS = frozenset("br hr img input meta link area base col embed source track wbr".split())


def _parts(name: str) -> list[str]:
    """The words of a name: between hyphens, underscores and changes of case, without numbers."""
    return [x for x in re.split(r"[_-]+|(?<=[a-z0-9])(?=[A-Z])", name) if x and not x.isdigit()]


def _says_removed(name: str, words: frozenset[str] = REMOVED_NAMES) -> bool:
    parts = [x.lower() for x in _parts(name)]
    if words.isdisjoint(parts) or not STATE_NAMES.isdisjoint(parts):
        return False
    return parts[0] in ENDING_NAMES or parts[-1] in ENDING_NAMES | LAST_NAMES or all(x in REMOVED_NAMES or x in PLAIN_NAMES for x in parts)


def _named(attributes: str, words: frozenset[str] = REMOVED_NAMES) -> bool:
    return any(_says_removed(name, words) for values in NAMES.findall(attributes) for name in "".join(values).split())


def _removed(tag: str, attributes: str, named: bool = True) -> bool:
    """``named``: its name may say so, too. An article's may only say that it is a comment."""
    if tag in REMOVED_TAGS:
        return True
    if not attributes:
        return False
    if tag in NAMED_TAGS and named and _named(attributes, COMMENT_NAMES if tag == "article" else REMOVED_NAMES):
        return True
    return tag not in VOID_TAGS and bool(HIDDEN.search(attributes))


def _holders(page: str) -> set[int]:
    """Where the tags of containers stand that hold an article, other than a comment, or main."""
    if not ARTICLE.search(page):
        return set()
    found: set[int] = set()
    stack: list[tuple[str, int]] = []
    many: Counter[str] = Counter()
    marked = 0
    for token in TOKEN.finditer(page):
        tag = (token["tag"] or token["tag2"] or "").lower()
        if tag not in SECTION_TAGS or tag in VOID_TAGS:
            continue
        if token["close"] or token["close2"]:
            while many[tag]:
                last, _ = stack.pop()
                many[last] -= 1
                if last == tag:
                    break
            marked = min(marked, len(stack))
            continue
        if tag == "main" or tag == "article" and not _named(token["attributes"] or "", COMMENT_NAMES):
            found.update(at for _, at in stack[marked:])
            marked = len(stack)
        if not (token["attributes"] or "").endswith("/"):
            stack.append((tag, token.start()))
            many[tag] += 1
    return found


class Line(NamedTuple):
    """A block's text (blank for an edge), its weight, whether it is a heading, the number of its article (0: none),
    and its container and that one's parent."""

    text: str
    weight: int
    heading: bool
    article: int
    place: tuple[int, int]


def to_lines(page: str) -> list[Line]:
    lines: list[Line] = []
    buffer: list[str] = []
    holders = _holders(page)
    #: Open containers and their numbers; the page is number 0. Tags that are open, outside and inside what is removed.
    stack: list[tuple[str, int]] = [("", 0)]
    outer: Counter[str] = Counter()
    inner: list[str] = []
    within: Counter[str] = Counter()
    articles, seen, skipped, at, made = 0, 0, "", 0, 0
    linked, link_chars, heading = False, 0, False

    def end_line(blanks: int = 0) -> None:
        nonlocal link_chars, linked
        text = " ".join(html.unescape("".join(buffer)).split()) if buffer else ""
        buffer.clear()
        place = (stack[-1][1], stack[-2][1] if len(stack) > 1 else 0)
        if text:
            lines.append(Line(text, max(0, len(text) - 2 * link_chars), heading, seen if articles else 0, place))
        if blanks and lines and lines[-1].text:
            lines.extend([Line("", 0, False, 0, place)] * blanks)
        linked, link_chars = False, 0

    for token in TOKEN.finditer(page):
        if not skipped and token.start() > at:
            buffer.append(page[at:token.start()])
            link_chars += linked * len(buffer[-1].strip())
        at = token.end()
        tag = (token["tag"] or token["tag2"] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(token["close"] or token["close2"]), token["attributes"] or ""
        block = tag in LINE_TAGS or tag in SECTION_TAGS
        if skipped:
            if skipped in SHORT_TAGS:
                if block and tag != skipped or tag == skipped and not closing:
                    skipped = ""
                elif tag == skipped:
                    skipped = ""
                    continue
            elif closing and within[tag]:
                while (last := inner.pop()) != tag:
                    within[last] -= 1
                within[tag] -= 1
                if not inner:
                    skipped = ""
                    continue
            elif closing and outer[tag]:
                # Its parent ends, so what was never closed ends, too.
                skipped = ""
            elif not closing and (tag in SECTION_TAGS or tag == skipped) and tag not in VOID_TAGS and not attributes.endswith("/"):
                inner.append(tag)
                within[tag] += 1
            if skipped:
                continue
        if not closing and tag not in VOID_TAGS and _removed(tag, attributes, token.start() not in holders):
            end_line(WINDOW_LINES)
            if not attributes.endswith("/"):
                skipped, inner = tag, [tag]
                within = Counter(inner)
        elif tag in SECTION_TAGS:
            end_line(WINDOW_LINES)
            if tag in ("article", "main"):
                seen += not articles and not closing
                articles = max(0, articles + (-1 if closing else 1))
            if closing:
                while outer[tag]:
                    last, _ = stack.pop()
                    outer[last] -= 1
                    if last == tag:
                        break
            elif tag not in VOID_TAGS and not attributes.endswith("/"):
                made += 1
                stack.append((tag, made))
                outer[tag] += 1
        elif block:
            end_line()
        elif tag == "a":
            linked = not closing
        if block:
            heading = tag in HEADINGS and not closing
    if not skipped:
        buffer.append(page[at:])
    end_line()
    return lines


def _runs(lines: list[Line], window: int) -> list[tuple[int, int, int]]:
    """First line, end, and the greatest weight of a window, of each run of lines between blank windows."""
    lengths, weights = (np.fromiter(x, np.int64, len(lines)) for x in ((len(x.text) for x in lines), (x.weight for x in lines)))
    if not weights.any():
        weights = lengths
    # Sum i covers lines i .. i + window - 1.
    sums, weighed = (np.convolve(np.r_[x, np.zeros(window - 1, np.int64)], np.ones(window, np.int64), "valid") for x in (lengths, weights))
    edges = np.flatnonzero(np.diff(np.r_[False, sums > 0, False]))
    return [(a, b, int(weighed[a:b].max())) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def _in_article(lines: list[Line], window: int) -> list[str]:
    """From the first surge to the last dive point of an article."""
    runs = _runs(lines, window)
    surging = [n for n, (_, _, top) in enumerate(runs) if top > 0]
    # A linked heading is no list of links.
    first = min([surging[0], *(n for n, (a, b, _) in enumerate(runs) if n < surging[0] and any(x.heading for x in lines[a:b]))])
    kept = [x for a, b, _ in runs[first:surging[-1] + 1] for x in lines[a:b] if x.text]
    if surging[-1] < len(runs) - 1:
        while len(kept) > 1 and kept[-1].heading:
            kept.pop()
    return [x.text for x in kept]


def _in_page(lines: list[Line], window: int, floor: int) -> list[str]:
    """From the first surge to the last dive point of each parent container, and short runs of text beside."""
    runs = _runs(lines, window)
    places = [{p for x in lines[a:b] if x.text for p in x.place} for a, b, _ in runs]
    # Where no run rises above the floor, the highest do.
    floor = min(floor, max(top for *_, top in runs))
    surging = [n for n, (_, _, top) in enumerate(runs) if top >= floor]
    reach: dict[int, tuple[int, int]] = {}
    for n in surging:
        for place in places[n]:
            reach[place] = reach.get(place, (n, n))[0], n
    kept = []
    for n, (a, b, top) in enumerate(runs):
        family = places[n] & reach.keys()
        if n in surging or family and (top > 0 or any(reach[p][0] < n < reach[p][1] for p in family)):
            kept.extend(x.text for x in lines[a:b] if x.text)
    return kept


def main_text(page: str, window: int = WINDOW_LINES, surge: int = SURGE) -> str:
    """The main text of a page, its blocks joined by a space."""
    lines = to_lines(page)
    if not lines:
        return ""
    numbers = sorted({x.article for x in lines if x.article})
    if not numbers:
        return " ".join(_in_page(lines, window, surge))
    blank = Line("", 0, False, 0, (0, 0))
    kept = []
    at = 0
    for number in numbers:
        # An article's lines stand together, with edges between them.
        first = next(n for n in range(at, len(lines)) if lines[n].article == number)
        at = next((n for n in range(first, len(lines)) if lines[n].article not in (0, number)), len(lines))
        kept.extend(_in_article([x if x.article == number else blank for x in lines[first:at]], window))
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    A null or empty page, and one without text, has the empty text. Pages are
    read whole; repeated rows are treated alike, and other columns not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
