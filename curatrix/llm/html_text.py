"""Main text of HTML pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams events. Text between block boundaries is a line; every line has its characters and
its tags, and the ratio of both, smoothed along the page, is high in an article and low in menus. Lines cluster at
a threshold that the page's own ratios set. The content region is the element that holds most text of the high cluster: an
article or main element if one does, else the innermost that does. What the page says of its parts is a weight on the
ratios, and text in nav, form and the like is left out, wherever it stands in a line. Time grows with the page's length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
#: Weights of lines in a main and in an article element.
IN_MAIN, IN_ARTICLE = 1.2, 1.5
#: Shares of the high cluster's text that make an article or main element, and any other, the region.
MARKED_SHARE, INNER_SHARE = 0.7, 0.9
#: What elements mean.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title svg math canvas object iframe audio video textarea select datalist".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CHROME = frozenset("nav footer aside form button menu dialog search".split())
CONTENT = frozenset("article main".split())
CONTAINERS = frozenset("article body center div fieldset main section td".split())
#: Words of class names and ids that say what is left out; they count where all other words of the name are in PLAIN_NAMES.
CHROME_NAMES = frozenset("ad ads adsbygoogle adsense advert adverts advertisement advertisements advertising alert alerts breadcrumb breadcrumbs comment comments commentlist consent cookie cookiebanner cookiebar cookieconsent cookienotice cookies copyright disqus footer gdpr login menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup popups promo promos promoted promotion recommendations recommended related replies reply respond responses share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription toast toolbar trending widget widgets".split())
HEADER_NAMES = frozenset("banner header masthead topbar".split())
PLAIN_NAMES = CHROME_NAMES | HEADER_NAMES | frozenset("above area articles author avatar bar below block body bottom box btn button buttons col column container content data date float form global google group holder icon icons inline inner item items left link links list main media message meta module outer page panel popular post posts primary reader readers right rows section secondary site slot small stories sticky story tab text thread top unit user users wrap wrapper".split())
#: Words of the class names of an article's own header.
OWN_HEADER = frozenset("article entry post story".split())
#: Whole class names of parts that are left out, and of text that is not shown.
CHROME_WHOLE = frozenset("back-to-top more-articles more-stories read-next see-also skip-link skip-to-content top-bar you-may-also-like".split())
HIDDEN_NAMES = frozenset("screen-reader-text sr-only visually-hidden visuallyhidden".split())
#: Whole class names of articles that are no article.
OTHER_ARTICLES = frozenset("ad advert comment comments promo related reply sponsored teaser".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
IMPLIED_END = {k: v.split() for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
LISTS = ("ul", "ol", "dl", "table", "select")
#: An end tag that is not of these closes nothing beyond a table or a region.
FAR_ENDS = frozenset("html body article main div section table".split())
BARRIERS = frozenset("table article body main".split())
SPLIT = re.compile(r"[-_]+")
#: What ends an open paragraph when it begins.
ENDS_P = BLOCKS - {"li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary", "body", "html"}


def is_chrome(names: str, words: frozenset) -> bool:
    """Whether a class name or id is made of words that say what is left out; "share-price" and "has-sidebar" are not."""
    for name in names.lower().split():
        if name in CHROME_WHOLE:
            return True
        parts = SPLIT.split(name)
        if not words.isdisjoint(parts) and all(p in PLAIN_NAMES or p.isdigit() for p in parts):
            return True
    return False


class Lines(HTMLParser):
    """The page's lines: [text, tags, link characters, weight, container, heading]. containers: of each its parent and
    whether the page marks it as content."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.fresh = True
        self.weight, self.place, self.heading = 1.0, 0, False  # where the line's first text stands
        self.containers: list[tuple[int, bool]] = [(-1, False)]
        # Open elements: name, and inside it: unseen, left out, left out by a name only, link, weight, container.
        self.open: list[tuple[str, bool, bool, bool, bool, float, int]] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # where elements of a name are open
        self.blocks: list[int] = []
        self.barriers: list[int] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append([text, self.tags, self.linked, self.weight, self.place, self.heading])
            self.tags = self.linked = 0
        self.text, self.fresh = [], True

    def close_to(self, at: int) -> None:
        """Close the open elements from at on."""
        if self.blocks and self.blocks[-1] >= at:
            self.end_line()
        while len(self.open) > at:
            name = self.open.pop()[0]
            self.at[name].pop()
            for stack in (self.blocks, self.barriers):
                if stack and stack[-1] == len(self.open):
                    stack.pop()

    def last(self, names: list[str] | tuple[str, ...]) -> int:
        return max((self.at[n][-1] for n in names if self.at[n]), default=-1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open and self.open[-1][0] == "head" and tag not in IN_HEAD:
            self.close_to(len(self.open) - 1)  # the end tag of a head may be left out
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        elif tag == "br":
            self.text.append(" ")
        if tag in ENDS_P:
            if self.blocks and self.open[self.blocks[-1]][0] == "p":
                self.close_to(self.blocks[-1])
        elif tag in IMPLIED_END and (at := self.last(IMPLIED_END[tag])) > self.last(LISTS):
            self.close_to(at)
        if tag in VOID:
            return
        _, unseen, out, by_name, link, weight, container = self.open[-1] if self.open else ("", False, False, False, False, 1.0, 0)
        given = {k: v or "" for k, v in attrs}
        names = f"{given.get('class', '')} {given.get('id', '')} {given.get('aria-label', '').replace(' ', '-')}" if given else ""
        role, whole = given.get("role"), tag in ("html", "body", "main")
        marked = tag in CONTENT or role in ("main", "article") or given.get("itemprop") == "articleBody"
        own_header = weight >= IN_ARTICLE or not OWN_HEADER.isdisjoint(SPLIT.split(names.lower().replace(" ", "-")))
        if tag in UNSEEN or names and not HIDDEN_NAMES.isdisjoint(names.lower().split()) or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
            unseen = True
        elif tag == "article":
            other = not OTHER_ARTICLES.isdisjoint(names.lower().split())
            if out and by_name and not other:
                out = by_name = False  # a wrapper's name does not settle what an article in it is; its ratios do
            elif other and not out:
                out, by_name = True, False
        elif tag == "main" and by_name:
            out = by_name = False
        elif (by_name or not out) and (tag in CHROME or role in CHROME_ROLES or tag == "header" and not own_header):
            out, by_name = True, False
        elif not out and not whole and (is_chrome(names, CHROME_NAMES) or not own_header and is_chrome(names, HEADER_NAMES)):
            out, by_name = True, True
        if marked and not out:
            weight = max(weight, IN_MAIN if tag == "main" or role == "main" else IN_ARTICLE)
        if tag in CONTAINERS or marked:
            self.containers.append((container, marked and not out))
            container = len(self.containers) - 1
        place = len(self.open)
        self.open.append((tag, unseen, out, by_name, link or tag == "a", weight, container))
        self.at[tag].append(place)
        if tag in BLOCKS:
            self.blocks.append(place)
        if tag in BARRIERS:
            self.barriers.append(place)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCKS:
            self.end_line()
        where = self.at[tag]
        if where and (tag in FAR_ENDS or not self.barriers or where[-1] > self.barriers[-1]):
            self.close_to(where[-1])

    def handle_data(self, data: str) -> None:
        seen = bool(data.strip())
        if seen and self.open and self.open[-1][0] == "head":
            self.close_to(len(self.open) - 1)
        _, unseen, out, _, link, weight, container = self.open[-1] if self.open else ("", False, False, False, False, 1.0, 0)
        if unseen or out:
            return
        if seen and self.fresh:
            self.weight, self.place, self.heading, self.fresh = weight, container, bool(self.at["h1"]), False
        self.text.append(data)
        if link:
            self.linked += len(data)

    def finish(self, html: str) -> list[list]:
        self.feed(html)
        self.close()
        self.end_line()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma) or 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def high_lines(ratios: np.ndarray) -> np.ndarray:
    """Which lines are in the high one of two clusters along the smoothed ratios: the threshold settles midway between
    their means. Where all lines are alike, all are."""
    smooth = smoothed(ratios)
    threshold = smooth.mean()
    for _ in range(50):
        high = smooth >= threshold
        if high.all() or not high.any():
            break
        now = (smooth[high].mean() + smooth[~high].mean()) / 2
        if abs(now - threshold) < 1e-9:
            break
        threshold = now
    if smooth.max() < 2.5 * max(smooth.min(), 1e-9):
        threshold = 0
    return smooth >= threshold


def region(lines: list[list], high: np.ndarray, containers: list[tuple[int, bool]]) -> tuple[list[bool], bool]:
    """Which lines lie in the content region, and whether the page marks it as content."""
    held = [0] * len(containers)
    for x, h in zip(lines, high):
        held[x[4]] += len(x[0]) if h else 0
    for c in range(len(containers) - 1, 0, -1):  # containers come after their parents
        held[containers[c][0]] += held[c]
    chosen, marked = 0, False
    for c, (parent, mark) in enumerate(containers):
        # Of elements that hold so much, each lies in the one before.
        if mark and held[c] >= MARKED_SHARE * held[0]:
            chosen, marked = c, True
    if not marked:
        for c in range(len(containers)):
            if held[c] >= INNER_SHARE * held[0]:
                chosen = c
    inside = [False] * len(containers)
    inside[chosen] = True
    for c in range(chosen + 1, len(containers)):
        inside[c] = inside[containers[c][0]]
    return [inside[x[4]] for x in lines], marked


def main_text(html: str | None) -> str:
    """The blocks of the page's main text, one a line; empty for a page without any."""
    page = Lines()
    lines = page.finish(html or "")
    if not lines:
        return ""
    high = high_lines(np.array([weight * len(t) / max(1, tags) * (1 - min(1, linked / len(t))) for t, tags, linked, weight, *_ in lines]))
    inside, marked = region(lines, high, page.containers)
    if marked:
        return "\n".join(x[0] for x, i in zip(lines, inside) if i)
    # From the first high line in the region to the last, and on over lines without links; a page's heading goes before.
    at = np.flatnonzero(high & np.array(inside))
    if not len(at):
        at = np.flatnonzero(high)
    first, last = at[0], at[-1]
    while first > 0 and inside[first - 1] and not lines[first - 1][2]:
        first -= 1
    while last < len(lines) - 1 and inside[last + 1] and not lines[last + 1][2]:
        last += 1
    keep = [first <= i <= last and (inside[i] or bool(high[i])) and 2 * x[2] < len(x[0]) for i, x in enumerate(lines)]
    if not any(x[5] for x, k in zip(lines, keep) if k):
        heads = [i for i in range(first) if lines[i][5]]
        if heads:
            keep[heads[-1]] = True
    return "\n".join(x[0] for x, k in zip(lines, keep) if k)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted_text(pages: DataFrame) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars (code points).

    A null or empty page, and one without main text, has an empty text. Repeated rows stay. Other columns are ignored.
    Each page is parsed alone, so neither hosts with many pages nor long pages meet in a task.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
