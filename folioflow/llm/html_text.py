"""Main text of web pages: parser events, text-to-tag ratios by line, Gaussian smoothing, threshold clustering.

The standard library's parser feeds its events to a collector that cuts the page into lines at block elements and
counts the tags of each. A line's ratio is its characters outside links for each tag, nothing for lines inside elements that
never hold an article's text (menus, forms, adverts, ...). The ratios are smoothed with a Gaussian, lines above one share of
the smoothed ratios' standard deviation are content, and runs of them clusters. The clusters say which region of the page is
the article: of ``article`` and ``main`` elements those with most content, where the rest of the page has not far more, else the
smallest region with all clusters but clear outliers. All its lines but excluded ones and menus of links are the
text, so its headings and short paragraphs stay. Inside an article a name that may mean something else there (``related-work``,
``notice-of-death``) excludes nothing by itself: the element goes only if its own smoothed ratio is below the lines' threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SIGMA, RADIUS, SHARE = 1.0, 2, 0.5
#: ``article`` and ``main`` count for nothing where more than so many times their content stands outside them.
TRUST = 2
#: So many lines in a row that are links but for this share of their characters are a menu.
MENU_LINES, MENU_SHARE = 3, 0.1
#: A cluster of content apart from the others is left out at the page's ends below this share of the largest one.
OUTLIER = 0.1

# Kinds of elements and names in classes, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary"
    " table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT = frozenset("p li blockquote pre dd dt td th figcaption caption address summary".split())
REGIONS = frozenset("article main section div body td html".split())
NEVER = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea input iframe svg canvas"
    " object audio video map menu dialog datalist math".split()
)
NOT_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner sidebar"
    " sidebars nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal"
    " overlay newsletter subscribe signup share sharing social related recommended recommendations comment comments"
    " respond disqus replies widget widgets pagination pager toolbar masthead skip login paywall contentinfo"
    " complementary search dialog alert alertdialog tags byline".split()
)
#: Of these, names that also stand for parts of an article; the others do only beside words of their own.
LOOSE = frozenset(
    "related recommended recommendations social widget widgets search dialog alert alertdialog masthead tags byline share sharing login".split()
)
NEUTRAL = frozenset(
    "left right top bottom box bar list links link block item items content main inner outer section area wrap wrapper container row"
    " col column grid module site page global primary secondary mobile desktop sticky fixed form title header heading button"
    " buttons icon icons text body post entry article story layout level unit slot zone group parent child children author meta".split()
)
HEADERS = frozenset(("header", "banner", "masthead", "byline", "tags"))
TEASERS = NOT_CONTENT - HEADERS | frozenset("teaser teasers reply".split())
MORE = frozenset("more teaser teasers".split())  # outside of an article, what leads to others
CONTENT = frozenset("article content main post entry story body text page wrapper container layout".split())
AROUND = frozenset("wrap wrapper container layout page body area row inner outer".split())
ABOUT = frozenset("has with no without free open enabled closed".split())
ALWAYS = frozenset("comment comments ad ads sidebar".split())
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
WHITE = re.compile(r"\s+")


@dataclass
class Element:
    tag: str
    number: int
    excluded: bool
    article: bool
    main: bool
    teaser: bool
    link: bool = False
    doubtful: int = 0


@dataclass
class Line:
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    path: tuple[int, ...] = ()
    excluded: bool = True
    teaser: bool = False
    tag: str = ""
    doubtful: int = 0
    article: bool = False


class Collector(HTMLParser):
    """Cuts a page into lines; ``named`` says whether names in classes and ids exclude elements."""

    def __init__(self, named: bool = True):
        super().__init__(convert_charrefs=True)
        self.named = named
        self.open: list[Element] = []
        self.regions: list[str] = []
        self.lines: list[Line] = []
        self.line = Line()
        self.n_doubtful = 0

    def cut(self) -> None:
        if self.line.parts or self.line.tags:
            self.lines.append(self.line)
            self.line = Line()

    def is_named(self, attrs: list[tuple[str, str | None]], kinds: frozenset[str], sure: bool = False) -> bool:
        """Whether a role, a class or the id says that the element is of such a kind, if ``sure`` beyond doubt.

        A class of several words counts by any of them (``footer-content``), unless it tells of something elsewhere
        (``has-sidebar``) or of what is around (``content-sidebar-wrap``). Beside a class that names content as such, only a
        few kinds count, and only as a class of their own. Beyond doubt is a class that has no word but such kinds and
        neutral ones (``ad-box``, ``comment-list``), and not of kinds that articles have parts of.
        """
        found = dict(attrs)
        if kinds & set((found.get("role") or "").lower().split()):
            return True
        classes = [{w.lower(): None for w in NAME.findall(c)} for k in ("class", "id") for c in (found.get(k) or "").split()]
        if any(c and c.keys() <= CONTENT for c in classes):
            return any(c and c.keys() <= kinds & ALWAYS for c in classes)
        for c in map(list, classes):
            if set(c) & ABOUT or c and c[0] in CONTENT and c[-1] in AROUND:
                continue
            if set(c) & kinds and not (sure and not (set(c) & kinds - LOOSE and all(w in kinds | NEUTRAL or w.isdigit() for w in c))):
                return True
        return False

    def is_doubtful(self, tag: str, attrs: list[tuple[str, str | None]], up: Element) -> bool:
        """Whether names exclude a block inside an article, but not beyond doubt."""
        return self.named and bool(attrs) and tag in BLOCKS and (up.article or up.main) and self.is_named(attrs, NOT_CONTENT - HEADERS)

    def excludes(self, tag: str, attrs: list[tuple[str, str | None]], up: Element) -> bool:
        inside = up.article or up.main
        if tag in NEVER:
            return True
        if tag == "header":
            return not inside
        if tag in ("html", "body", "main"):
            return False
        found = dict(attrs)
        if "hidden" in found or found.get("aria-hidden") == "true" or HIDDEN.search(found.get("style") or ""):
            return True
        if tag == "article":
            return up.article and self.named  # a reader's comment or a teaser within the article
        if not self.named or not attrs:
            return False
        known = NOT_CONTENT - HEADERS if inside else NOT_CONTENT | {"header"} | MORE
        return self.is_named(attrs, known, sure=inside)

    def close_to(self, at: int) -> None:
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.cut()
            kinds, bounds = CLOSES.get(tag, ("p", ()))
            kinds = kinds.split()
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at].tag in kinds or tag == "body" and self.open[at].tag == "head":
                    self.close_to(at)
                    break
                if self.open[at].tag in bounds or not bounds and tag != "body" and self.open[at].tag in BLOCKS:
                    break
        self.line.tags += 1
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        up = self.open[-1] if self.open else Element("", -1, False, False, False, False)
        number = up.number
        if tag in REGIONS:
            number = len(self.regions)
            self.regions.append(tag)
        excluded = up.excluded or self.excludes(tag, attrs, up)
        teaser = up.teaser or tag == "article" and self.named and self.is_named(attrs, TEASERS)
        link = up.link or tag == "a"
        doubtful = up.doubtful
        if not excluded and not doubtful and self.is_doubtful(tag, attrs, up):
            self.n_doubtful = doubtful = self.n_doubtful + 1
        self.open.append(Element(tag, number, excluded, up.article or tag == "article", up.main or tag == "main", teaser, link, doubtful))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1].tag == tag and tag in ("svg", "math"):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        block = tag in BLOCKS
        if block:
            self.cut()
        self.line.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag:
                self.close_to(at)
                return
            if not block and self.open[at].tag in BLOCKS:
                return  # an inline end tag closes nothing outside its block

    def handle_data(self, data: str) -> None:
        up = self.open[-1] if self.open else None
        if not self.line.parts:
            if data.isspace():
                return
            self.line.excluded, self.line.teaser = (up.excluded, up.teaser) if up else (False, False)
            self.line.path = tuple(dict.fromkeys(e.number for e in self.open if e.number >= 0))
            self.line.tag = next((e.tag for e in reversed(self.open) if e.tag in BLOCKS), "")
            self.line.doubtful, self.line.article = (up.doubtful, up.article or up.main) if up else (0, False)
        if up is None or up.excluded == self.line.excluded:
            self.line.parts.append(data)
            if up is not None and up.link:
                self.line.linked += len(WHITE.sub(" ", data).strip())

    def close(self) -> None:
        super().close()
        self.cut()


def smooth(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Weighted means of each ratio's neighbours under a Gaussian; the ends lack some and weigh the rest."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    same = lambda x: np.convolve(x, kernel)[radius : radius + len(x)]
    return same(ratios) / same(np.ones(len(ratios)))


def content_lines(ratio: np.ndarray, share: float = SHARE) -> np.ndarray:
    """Which lines are content: their smoothed ratio reaches ``share`` of the smoothed ratios' standard deviation."""
    level = smooth(ratio)
    return level >= share * level.std()


def _menus(texts: list[str], lines: list[Line], usable: list[bool]) -> set[int]:
    """Lines in runs that hold little but links, within one element's list of lines.

    In an article a run that has a heading of its own is no menu: a list of sources or of further steps is a part of the text.
    """
    found, run, before = set(), [], None
    kept = [k for k, u in enumerate(usable) if u]
    for n, i in enumerate([*kept, None]):
        if i is not None and len(texts[i]) - lines[i].linked <= MENU_SHARE * len(texts[i]) and (not run or lines[run[-1]].article == lines[i].article):
            before = before if run else kept[n - 1] if n else None
            run.append(i)
            continue
        if len(run) >= MENU_LINES:
            headed = before is not None and lines[before].tag in HEADINGS - {"h1"} and lines[before].article
            if not (headed and lines[run[0]].article):
                found.update(run)
        run = []
        if i is not None and len(texts[i]) - lines[i].linked <= MENU_SHARE * len(texts[i]):
            before, run = kept[n - 1] if n else None, [i]
    return found


def _doubted(lines: list[Line], ratio: np.ndarray, texts: list[str], usable: list[bool], share: float) -> set[int]:
    """Lines of the doubtful elements whose own smoothed ratio, weighted by their texts, is below the lines' threshold."""
    least = share * smooth(ratio).std()
    found: set[int] = set()
    for n in {x.doubtful for x in lines} - {0}:
        own = [i for i, x in enumerate(lines) if x.doubtful == n and usable[i]]
        if own and np.average(smooth(ratio[own]), weights=[len(texts[i]) for i in own]) < least:
            found.update(own)
    return found


def _select(lines: list[Line], regions: list[str], share: float) -> list[str]:
    """Texts of the lines in the article's region."""
    texts = [WHITE.sub(" ", "".join(x.parts)).strip() for x in lines]
    usable = [bool(t) and not x.excluded for t, x in zip(texts, lines, strict=True)]
    menus = _menus(texts, lines, usable)
    if sum(usable) > len(menus):
        usable = [u and i not in menus for i, u in enumerate(usable)]
    if not any(usable):
        return []
    plain = [max(0, len(t) - x.linked) if u else 0 for t, x, u in zip(texts, lines, usable, strict=True)]
    ratio = np.array([n / max(1, x.tags) for n, x in zip(plain, lines, strict=True)])
    doubted = _doubted(lines, ratio, texts, usable, share)
    if doubted and sum(usable) > len(doubted):
        usable = [u and i not in doubted for i, u in enumerate(usable)]
        plain = [n if u else 0 for n, u in zip(plain, usable, strict=True)]
        ratio = np.where(usable, ratio, 0.0)
    content = [i for i in np.flatnonzero(content_lines(ratio, share)).tolist() if usable[i]]
    content = content or [int(np.argmax(np.where(usable, ratio, -1.0)))]
    # comments and teasers in elements of their own go where an article or main holds content beside them
    marked = lambda i: any(regions[r] in ("article", "main") for r in lines[i].path)
    if any(x.teaser for x in lines) and (rest := [i for i in content if not lines[i].teaser and marked(i)]):
        content = rest
        usable = [u and not x.teaser for u, x in zip(usable, lines, strict=True)]
    inside: dict[int, int] = {}
    for i in content:
        for r in lines[i].path:
            inside[r] = inside.get(r, 0) + plain[i]
    outside = sum(plain[i] for i in content if not marked(i))
    best = max((r for r in inside if regions[r] in ("article", "main")), key=lambda r: (inside[r], r), default=None)
    if best is not None and outside <= TRUST * sum(plain[i] for i in content if marked(i)):
        path = next(lines[i].path for i in content if best in lines[i].path)
        best = next((r for r in path[: path.index(best)] if regions[r] == "main"), best)
        # every article of the page with text of its own, so parts in sibling articles stay and cards of links go
        words: dict[int, int] = {}
        for i, x in enumerate(lines):
            for r in x.path if usable[i] else ():
                words[r] = words.get(r, 0) + plain[i]
        in_article = lambda x: any(regions[r] == "article" and words.get(r, 0) > 0 for r in x.path)
        if regions[best] == "article":
            own = [i for i, x in enumerate(lines) if usable[i] and in_article(x)]
            return [texts[i] for i in own]
        own = [i for i, x in enumerate(lines) if usable[i] and best in x.path]
        held = {i for i in own if in_article(lines[i])}
        if not held or any(best in lines[i].path and i not in held for i in content):
            return [texts[i] for i in own]
        # main's content is in its articles: all of them, each with the headings ahead of it
        for at in range(len(own) - 1, 0, -1):
            if own[at] in held and lines[own[at - 1]].tag in HEADINGS:
                held.add(own[at - 1])
        return [texts[i] for i in own if i in held]
    # no element says where the article is: the smallest region with every cluster of content but outliers
    seeds = _without_outliers(content, texts, usable)
    shared = set(lines[seeds[0]].path).intersection(*(lines[i].path for i in seeds))
    best = max(shared, default=None)
    while best is not None and regions[best] == "section":  # a section is a part of what is around it
        best = max((r for r in shared if r < best), default=None)
    here = [i for i, x in enumerate(lines) if usable[i] and (best is None or best in x.path)]
    first, last = here.index(seeds[0]), here.index(seeds[-1])
    while first > 0 and lines[here[first - 1]].tag in TEXT | HEADINGS:
        first -= 1
    for at in range(last + 1, len(here)):
        if lines[here[at]].tag in TEXT:
            last = at  # and the headings before it
        elif lines[here[at]].tag not in HEADINGS:
            break
    return [texts[i] for i in here[first : last + 1]]


def _without_outliers(content: list[int], texts: list[str], usable: list[bool]) -> list[int]:
    """Content lines from the first to the last cluster that is not a clear outlier: a small one, apart from the others.

    Clusters are runs of content with at most ``RADIUS`` usable lines and no excluded text between them.
    """
    clusters = [[content[0]]]
    for i in content[1:]:
        between = range(clusters[-1][-1] + 1, i)
        if sum(usable[k] for k in between) > RADIUS or any(texts[k] and not usable[k] for k in between):
            clusters.append([])
        clusters[-1].append(i)
    sizes = [sum(len(texts[i]) for i in c) for c in clusters]
    kept = [n for n, size in enumerate(sizes) if size >= OUTLIER * max(sizes)]
    return [i for c in clusters[kept[0] : kept[-1] + 1] for i in c]


def main_text(html: str, share: float = SHARE) -> str:
    """The article's text, its blocks joined by line feeds; empty if the page has none. No input raises."""
    for named in (True, False):
        page = Collector(named)
        page.feed(html)
        page.close()
        found = _select(page.lines, page.regions, share)
        if found:
            return "\n".join(found)
    return ""


def extract(pages: DataFrame, html_col: str = "html", share: float = SHARE) -> DataFrame:
    """The input's rows and columns without the html, with ``text``: each page's main text.

    One row per input row, repeated rows included; an empty table gives an empty result. A null page counts as empty and
    gives an empty text, as does a page without text outside excluded elements. White space inside
    a block becomes one space, blocks are joined in page order by line feeds; nothing is capped. A column ``text`` of
    the input is replaced. No shuffle: pages are parsed where they are read, one Arrow batch at a time.
    """
    source = pages.drop(*({"text"} - {html_col})).withColumn(html_col, text_of(html_col))
    kept = [f for f in source.schema if f.name != html_col]
    place = source.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(x, share) for x in batch.column(place).to_pylist()], pa.string())
            rest = [i for i in range(batch.num_columns) if i != place]
            names = [*(batch.schema.names[i] for i in rest), "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), text], names)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return source.mapInArrow(run, f"{ddl}, text string" if ddl else "text string").select(
        *[F.col(f"`{f.name}`") for f in kept], "text"
    )
