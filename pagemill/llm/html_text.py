"""Main text of web pages by line-block distribution: text lengths over sliding windows of lines, and what lies between surge and dive."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import free_name

#: Lines in a window, and the text in one at which it surges.
WINDOW, SURGE = 3, 86
#: A line with a larger share of link text is a menu's outside an article, and weighs as one outside in an article.
MOST_LINKED = 0.5
#: A line in an article or main element weighs so much more, text in a form or under a listed name so much less for each it is in.
RAISED, LOWERED = 2, 4

#: Elements whose text is never the article's.
SKIPPED = frozenset("script style noscript template head nav footer aside button select textarea iframe object svg canvas dialog menu".split())
#: Elements that mostly hold the article where a page has them.
HOLDS_ARTICLE = frozenset(("article", "main"))
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class or id that tell what is around an article, and words that may stand beside them in a name. A name counts if each
#: of its words is one of these or a number, and one at least is of the first kind: share-buttons does, share-price doesn't.
AROUND = frozenset(
    "ad ads adbox adsbygoogle adslot advert advertisement advertisements advertising adverts alert alerts banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination popup promo promotion "
    "promotions recommendations recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription widget widgets".split()
)
BESIDE = frozenset(
    "area article articles author bar block body bottom box btn button buttons col column container content desktop dropdown fixed floating foot form global grid group head header heading "
    "holder icon icons inner item items left link links list main media message meta mobile outer page panel policy post posts primary reply right row secondary section site slot sticky "
    "stories story sub text thread title toggle tool tools top unit wrap wrapper zone".split()
)
#: Of the words of the first kind those that a page's own text may stand under too: such an area, a form, and one of these roles, gives way to the
#: article by its weight; the others come out whatever their size, as long as there is an article without them.
WEIGHED = frozenset("alert alerts banner banners login modal notice notices notification notifications overlay popup search signup skip widget widgets".split())
WEIGHED_ROLES = frozenset("form search dialog alert".split())
#: Words of areas in which readers write. Their text is the page's only where it has no other.
READERS = frozenset("comment comments commentlist disqus replies respond".split())
#: Removed elements that set apart what stands before and after them, outside an article.
SETS_APART = frozenset("nav footer header head menu".split())
PAGE_HEADER = re.compile(r"^(?:(?:site|page|top|main|global)[_-]?)?header$", re.IGNORECASE)
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)>")
#: What ends a tag, or begins a quoted value in which > ends nothing.
_END_OR_QUOTE = re.compile(r""">|=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))?)?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^\W\d_]+")


def is_around(name: str) -> bool:
    """Whether a class or id names what is around an article."""
    words = [w.lower() for w in _WORD.findall(name) if not w.isdigit()]
    return any(w in AROUND for w in words) and all(w in AROUND or w in BESIDE for w in words)


def attributes(text: str) -> dict[str, str]:
    """The attributes of a tag by name in lower case; of several of one name the first counts. A value is what its quotes hold."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


class _Tags:
    """Tags of a page one after another, in time linear in the page: what wasn't found once isn't looked for again."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """The place of what from at on, or -1."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose name ends at at, or -1. A quote that is never closed doesn't count."""
        while m := _END_OR_QUOTE.search(self.page, at):
            if m[0] == ">":
                return m.start()
            closed = self.find(m[1], m.end())
            if closed < 0:
                return self.find(">", m.end())
            at = closed + 1
        return -1

    def next(self, at: int) -> tuple[int, int, str, bool, str]:
        """(begin, end, name, whether it is an end tag, attributes) of the next tag or comment from at on; a comment's name is empty.

        A tag or comment that isn't ended goes to the page's end. A < that begins nothing is text.
        """
        page, size = self.page, len(self.page)
        while True:
            begin = self.find("<", at)
            if begin < 0:
                return size, size, "", False, ""
            if m := _PLAIN.match(page, begin):
                return begin, m.end(), m[2].lower(), m[1] == "/", ""
            c = page[begin + 1 : begin + 2]
            if c in ("!", "?"):
                if page.startswith("<!--", begin) and not page.startswith(("<!-->", "<!--->"), begin):
                    end = self.find("-->", begin + 4)
                    return begin, size if end < 0 else end + 3, "", False, ""
                end = self.find(">", begin)
                return begin, size if end < 0 else end + 1, "", False, ""
            closes = c == "/"
            m = _NAME.match(page, begin + 1 + closes)
            if m:
                end = self.end(m.end())
                return (begin, size, "", False, "") if end < 0 else (begin, end + 1, m[0].lower(), closes, page[m.end() : end])
            if closes:
                end = self.find(">", begin)
                return begin, size if end < 0 else end + 1, "", False, ""
            at = begin + 1


def _removed(name: str, marks: dict[str, str], in_article: bool) -> bool:
    return name in SKIPPED or name == "header" and not in_article or "hidden" in marks or marks.get("aria-hidden", "").lower() == "true"


def _around(name: str, marks: dict[str, str], in_article: bool) -> str | None:
    """What tells that an element is around the article rather than of it, or None."""
    if name == "form":
        return name
    for key in ("class", "id"):
        for x in marks.get(key, "").split():
            if is_around(x) or not in_article and PAGE_HEADER.match(x):
                return x
    role = marks.get("role", "")
    return role if role.lower() in AROUND_ROLES else None


class _Lines:
    """Lines of text of a page in order; each with its text, the characters of it in links, whether it is in an article, and its area.

    Area 0 is the page. Elements that look to be around the article are areas in the one that they lie in, those of one mark the same.
    """

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, bool, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.area, self.parents = 0, [0]
        self.kinds = ["page"]
        self.areas: dict[tuple[int, str], int] = {}

    def end(self, in_article: bool) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.linked, in_article, self.area))
        self.parts, self.linked = [], 0

    def gap(self, lines: int) -> None:
        self.lines += [("", 0, False, self.area)] * lines

    def enter(self, mark: str, kind: str) -> None:
        own = self.areas.setdefault((self.area, mark), len(self.parents))
        if own == len(self.parents):
            self.parents.append(self.area)
            around = self.kinds[self.area]
            self.kinds.append(around if around == "readers" or around == "strict" and kind != "readers" else kind)
        self.area = own

    def leave(self, in_article: bool) -> None:
        if not in_article:
            self.gap(1)
        self.area = self.parents[self.area]


def kind_of(mark: str) -> str:
    """What gives way to an article: an area of readers, a strict one, or one that is weighed."""
    words = {w.lower() for w in _WORD.findall(mark)}
    if words & READERS:
        return "readers"
    return "strict" if words & (AROUND - WEIGHED) or mark.lower() in AROUND_ROLES - WEIGHED_ROLES or PAGE_HEADER.match(mark) else "weighed"


def lines_of(page: str) -> tuple[list[tuple[str, int, bool, int]], list[int], list[str]]:
    """The page's markup stripped, and for each area the one it lies in and its kind. Outside an article a removed menu, header or footer and the end of an
    area become an empty line, an article's edge WINDOW of them; what else is removed leaves none, and inside an article nothing does."""
    out, tags = _Lines(), _Tags(page)
    stack: list[tuple[str, bool, bool]] = []  # name, skips, is an area
    opened: dict[str, list[int]] = {}  # places in the stack by name
    skipping = articles = links = 0
    at, size = 0, len(page)

    def close(upto: int) -> None:
        nonlocal skipping, articles, links
        while len(stack) > upto:
            name, skips, area = stack.pop()
            opened[name].pop()
            links -= name == "a"
            if skips:
                skipping -= 1
                if not skipping and not articles and name in SETS_APART:
                    out.gap(1)
                continue
            if area:
                out.end(articles > 0)
            if name in HOLDS_ARTICLE and not skipping:
                articles -= 1
                if not articles:
                    out.gap(WINDOW)
            if area:
                out.leave(articles > 0)

    while at < size:
        begin, end, name, closes, inside = tags.next(at)
        text = page[at:begin]
        if text and not skipping:
            text = html.unescape(text)
            out.parts.append(text)
            if links:
                out.linked += len(text.strip())
        at = end
        if not name:
            continue
        if closes:
            if name in BLOCKS and not skipping:
                out.end(articles > 0)
            if opened.get(name):
                k = opened[name][-1]
                # a stray end tag closes nothing around the article
                if not articles or name in HOLDS_ARTICLE or name in ("body", "html") or all(not opened.get(x) or opened[x][-1] < k for x in HOLDS_ARTICLE):
                    close(k)
            continue
        if name in BLOCKS:
            if not skipping:
                out.end(articles > 0)
            # a block ends an open paragraph, a list item one of the same list
            for k in range(len(stack) - 1, max(-1, len(stack) - 12), -1):
                if stack[k][0] == "p" or stack[k][0] == name == "li":
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name == "br":
            out.parts.append(" ")
        if name in VOID or inside.endswith("/") and name not in BLOCKS and not inside.rstrip("/").endswith("="):
            continue
        marks = attributes(inside) if inside and name not in ("html", "body") else None
        skips = _removed(name, marks or {}, articles > 0)
        if name in RAW:
            m = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            upto = m.start() if m else size
            if not skips and not skipping and name != "title":
                out.parts.append(html.unescape(page[at:upto]))
            over = tags.find(">", upto) if m else -1
            at = size if over < 0 else over + 1
            continue
        if skips:
            if not skipping:
                out.end(articles > 0)
            skipping += 1
        mark = None if skipping or not marks and name != "form" else _around(name, marks or {}, articles > 0)
        if mark is not None:
            out.end(articles > 0)
            out.enter(f"{name} {mark}", kind_of(mark))
        if name in HOLDS_ARTICLE and not skipping:
            if not articles:
                out.gap(WINDOW)
            articles += 1
        links += name == "a"
        opened.setdefault(name, []).append(len(stack))
        stack.append((name, skips, mark is not None))
    out.end(articles > 0)
    return out.lines, out.parents, out.kinds


def _weight(text: str, linked: int, in_article: bool) -> int:
    mostly_linked = linked > MOST_LINKED * len(text)
    return len(text) * (RAISED - mostly_linked if in_article else 1 - mostly_linked)


def _chosen(lines: list[tuple[str, int, bool, int]], parents: list[int], kinds: list[str]) -> int:
    """The area that holds the main text: the one with the densest run, each area weighing a LOWERED-th of the one that it lies in. As long as a run
    outside of the strict ones and those of readers is like an article (it surges, or is in an article element), none of these is it; and one of
    readers is only if no other has any text."""
    weights: list[list[int]] = [[] for _ in parents]
    articles = [False] * len(parents)
    for text, linked, inside, area in lines:
        weights[area].append(_weight(text, linked, inside))
        articles[area] |= inside and weights[area][-1] > 0
    depths, found = [0] * len(parents), []
    for area, own in enumerate(weights):  # an area comes after the one that it lies in
        if area:
            depths[area] = depths[parents[area]] + 1
        runs = between_surge_and_dive(own, 0)
        dense = max((sum(own[a:b]) for a, b, _ in runs), default=0) / LOWERED ** min(depths[area], 32)
        found.append((dense, -area, articles[area] or any(peak > SURGE for _, _, peak in runs)))
    open_ = [f for f, kind in zip(found, kinds, strict=True) if kind in ("page", "weighed")]
    if not any(like for _, _, like in open_):
        open_ = [f for f, kind in zip(found, kinds, strict=True) if kind != "readers"]
        if not any(dense for dense, _, _ in open_):
            open_ = found
    dense, area, _ = max(open_)
    return -area if dense else 0


def _within(lines: list[tuple[str, int, bool, int]], parents: list[int], kinds: list[str]) -> list[tuple[str, int, bool, int]]:
    """The lines of the area that holds the main text and of those it lies in; each other one becomes an empty line, in an article nothing."""
    if len(parents) == 1:
        return lines
    best = _chosen(lines, parents, kinds)
    holds = {0, best}
    while best:
        best = parents[best]
        holds.add(best)
    outer = list(range(len(parents)))
    for area in outer[1:]:
        if area not in holds and parents[area] not in holds:
            outer[area] = outer[parents[area]]
    out, before = [], -1
    for line in lines:
        area = line[3]
        if area in holds:
            out.append(line)
            before = -1
        elif outer[area] != before:
            before = outer[area]
            if not line[2]:
                out.append(("", 0, False, before))
    return out


def between_surge_and_dive(lengths: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Runs of lines and the most text in a window of each: a run begins where the text of a window of lines rises from nothing, ends
    where it dives to nothing, and surges above so much text between."""
    sums = [sum(lengths[k : k + window]) for k in range(len(lengths))]
    runs, begin, peak = [], None, 0
    for k, s in enumerate([*sums, 0]):
        if s and begin is None:
            begin, peak = k, 0
        if s:
            peak = max(peak, s)
        elif begin is not None:
            if peak > surge:
                runs.append((begin, k, peak))
            begin = None
    return runs


def main_text(page: str | None) -> str:
    """The article's blocks, one to a line: the runs of lines that surge, and if none does, the run with the most text. Where there are
    runs in articles and others, those that aren't like the densest must surge to more than half its height. A line within a run stays whatever its
    weight, and so do linked lines between two chosen runs if nothing sets these apart."""
    lines = _within(*lines_of(page or ""))
    weights = [_weight(text, linked, inside) for text, linked, inside, _ in lines]
    every = between_surge_and_dive(weights, 0)
    if not every:
        return ""

    def in_article(run: tuple[int, int, int]) -> bool:
        return any(lines[k][2] for k in range(run[0], run[1]))

    densest = max(every, key=lambda r: sum(weights[r[0] : r[1]]))
    like = in_article(densest)
    runs = [r for r in every if r[2] > SURGE and (in_article(r) == like or r[2] > densest[2] / RAISED)] or [densest]
    ranges = [_ends(weights, a, b) for a, b, _ in runs]
    between = [range(x.stop, y.start) for x, y in zip(ranges, ranges[1:], strict=False)]
    rows = [k for r in ranges for k in r] + [k for r in between if all(lines[k][0] for k in r) for k in r]
    return "\n".join(lines[k][0] for k in sorted(rows) if lines[k][0])


def _ends(weights: list[int], a: int, b: int) -> range:
    """The lines of a run from the first to the last that weighs something: a window rises WINDOW - 1 lines before the text that it sees."""
    while not weights[a]:
        a += 1
    while not weights[b - 1]:
        b -= 1
    return range(a, b)


def _texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([main_text(x) for x in batch.to_pylist()], pa.string())


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (its code points): the main text of each page's whole html.

    The text is empty for a null or empty page and for one without an article. Repeated rows give the same text. Columns of pages that
    have the name of a result are replaced by it.
    """
    _texts.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(_texts, "string")
    out = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    found = free_name(pages, "found_")
    told = pages.withColumn(found, udf(F.col(html_col).cast("string")))
    return told.select(*out, F.col(found).alias("text"), F.length(found).cast("long").alias("n_chars"))
