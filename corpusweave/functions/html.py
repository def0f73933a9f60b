"""HTML extraction on an index of the page's elements, built with the standard library's parser.

Elements are numbered in document order; what lies below element i has the numbers i + 1 to ends[i] - 1, and its text is one interval of
the page's text. So questions about ancestors, descendants and text are intervals, bisections and differences of running sums, and the
work grows with the page and with what is returned, however deep elements are nested.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cached_property
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np

from .text import DOCUMENT_EXTENSIONS
from .urls import host_of, resolve

SPACE = re.compile("[\\s\u000b   -     　﻿]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Structural elements that never belong to the text; elements that end an open paragraph.
BOILERPLATE = frozenset(("script", "style", "noscript", "template", "svg", "nav", "header", "footer", "aside"))
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"a": {"a"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "thead": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tfoot": {"tr", "td", "th", "thead", "tbody", "tfoot"}}
STOPS = {"a": {"table", "td", "th", "caption", "button"}, "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
LEAST_READABLE = 200
#: Beyond so many cells or characters of them, a page's nested tables don't repeat what the tables inside them hold.
MOST_CELLS, MOST_TEXT = 1 << 20, 1 << 24


class Page:
    """Elements in document order; number 0 is the page itself.

    spans: where an element's text begins and ends in ``text``; clean_spans: the same in ``clean``, the text outside boilerplate elements.
    """

    def __init__(self):
        self.tags: list[str] = []
        self.attrs: list[dict] = []
        self.parents: list[int] = []
        self.ends: list[int] = []
        self.spans: list[list[int]] = []
        self.clean_spans: list[list[int]] = []
        self.around: dict[int, tuple[int, int, int, int]] = {}  # of rows and cells: the nearest table, thead, tbody and tr above, -1 for none
        self.by_tag: dict[str, list[int]] = {}
        self.text = self.clean = ""

    def of(self, *tags: str) -> list[int]:
        """Elements of these tags in document order."""
        found = [self.by_tag.get(t, []) for t in tags]
        return found[0] if len(found) == 1 else sorted(sum(found, []))

    def below(self, i: int, some: list[int]) -> list[int]:
        """Those of some (in order) that lie below element i."""
        return some[bisect_right(some, i) : bisect_left(some, self.ends[i])]

    def text_of(self, i: int) -> str:
        return self.text[slice(*self.spans[i])]

    def clean_of(self, i: int) -> str:
        return self.clean[slice(*self.clean_spans[i])]

    @cached_property
    def _sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Running numbers of visible characters, of beginnings of words and of commas in the clean text; which characters are visible."""
        codes = np.frombuffer(self.clean.encode("utf-32-le", "surrogatepass"), np.uint32)
        spaces = np.fromiter({ord(x) for x in set(self.clean) if SPACE.fullmatch(x)}, np.uint32)
        shown = ~np.isin(codes, spaces)
        first = shown & ~np.concatenate([[False], shown[:-1]])[: len(shown)]
        run = lambda x: np.concatenate([[0], np.cumsum(x)])
        return run(shown), run(first), run(codes == ord(",")), shown

    def length(self, i: int) -> int:
        """Characters of the element's clean text once spaces are collapsed."""
        a, b = self.clean_spans[i]
        shown, first, _, at = self._sums
        words = int(first[b] - first[a]) + (1 if a < b and at[a] and a > 0 and at[a - 1] else 0)
        return int(shown[b] - shown[a]) + max(words - 1, 0)

    def commas(self, i: int) -> int:
        a, b = self.clean_spans[i]
        return int(self._sums[2][b] - self._sums[2][a])

    @cached_property
    def _linked(self) -> list[int]:
        return [0, *accumulate(b - a for a, b in (self.spans[i] for i in self.of("a")))]

    def linked(self, i: int) -> int:
        """Characters of the anchors below the element."""
        links = self.of("a")
        return self._linked[bisect_left(links, self.ends[i])] - self._linked[bisect_right(links, i)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open: list[int] = []
        self.where: dict[str, list[int]] = {}  # places in open, by tag
        self.parts: list[str] = []
        self.clean_parts: list[str] = []
        self.size = self.clean_size = self.hidden = 0
        self._push("#root", {})

    def _push(self, tag: str, attrs: dict) -> int:
        page, i = self.page, len(self.page.tags)
        page.tags.append(tag)
        page.attrs.append(attrs)
        page.parents.append(self.open[-1] if self.open else -1)
        page.ends.append(i + 1)
        page.spans.append([self.size, self.size])
        page.clean_spans.append([self.clean_size, self.clean_size])
        page.by_tag.setdefault(tag, []).append(i)
        if tag in ("tr", "td", "th", "table"):
            page.around[i] = tuple(self.open[self.where[t][-1]] if self.where.get(t) else -1 for t in ("table", "thead", "tbody", "tr"))
        self.where.setdefault(tag, []).append(len(self.open))
        self.open.append(i)
        self.hidden += tag in BOILERPLATE
        return i

    def _cut(self, place: int) -> None:
        """Ends the open elements from this place of the stack on."""
        while len(self.open) > place:
            i = self.open.pop()
            page = self.page
            self.where[page.tags[i]].pop()
            self.hidden -= page.tags[i] in BOILERPLATE
            page.ends[i] = len(page.tags)
            page.spans[i][1], page.clean_spans[i][1] = self.size, self.clean_size

    def _last(self, tags) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def _close(self, tags: set, stops: set) -> None:
        while (at := self._last(tags)) > self._last(stops):
            self._cut(at)
            if self._last(stops) >= 0:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, {"table", "td", "th", "div", "section", "article", "main", "body"})
        if tag in CLOSES:
            self._close(CLOSES[tag], STOPS.get(tag, {"table"}))
        self._push(tag, dict(attrs))
        if tag in VOID:
            self._cut(len(self.open) - 1)

    def handle_startendtag(self, tag, attrs):
        self._push(tag, dict(attrs))
        self._cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        at = self._last((tag,))
        if at > 0 and (tag in ("body", "html", "table") or at > self._last(("table",))):
            self._cut(at)

    def handle_data(self, data):
        self.parts.append(data)
        self.size += len(data)
        if not self.hidden:
            self.clean_parts.append(data)
            self.clean_size += len(data)

    def done(self) -> Page:
        self._cut(0)
        self.page.text, self.page.clean = "".join(self.parts), "".join(self.clean_parts)
        return self.page


def parse(html: str | None) -> Page:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.done()


def collapse(text: str) -> str:
    return SPACE.sub(" ", text).strip()


def title_of(page: Page) -> str | None:
    """The first title, else the first h1; read before anything is removed."""
    for tag in ("title", "h1"):
        found = page.of(tag)
        if found and (text := page.text_of(found[0])):
            return collapse(text) or None
    return None


def _outermost(page: Page, some: list[int]) -> list[int]:
    out: list[int] = []
    for i in some:
        if not out or i >= page.ends[out[-1]]:
            out.append(i)
    return out


def plain(page: Page) -> str:
    """Text of all main elements (of nested ones the outer), else of the body, without boilerplate and without separators between blocks."""
    hidden = _outermost(page, page.of(*BOILERPLATE))
    seen = lambda i: (k := bisect_right(hidden, i)) == 0 or i >= page.ends[hidden[k - 1]]
    inside = _outermost(page, [i for i in page.of("main") if seen(i)])
    if inside:
        return collapse("".join(map(page.clean_of, inside)))
    body = page.of("body")
    if body:
        a, b = page.clean_spans[body[0]]
        return collapse(page.clean[a:b]) if a < b or seen(body[0]) else collapse(page.text_of(body[0]))
    out, at = [], 0
    for i in _outermost(page, page.of("head")):
        out.append(page.clean[at : page.clean_spans[i][0]])
        at = page.clean_spans[i][1]
    return collapse("".join([*out, page.clean[at:]]))


ADS = re.compile(r"\b(ad|ads|advert|banner|comment|cookie|menu|promo|related|sidebar|social|sponsor)")


def readable(page: Page) -> tuple[str | None, str] | None:
    """A content-density reader: the container whose paragraphs hold the most text outside links, with those of its siblings that
    score a fifth as much, and sibling paragraphs that are prose: long and hardly linked, or a sentence without a link."""
    scores: dict[int, float] = {}
    i, n = 1, len(page.tags)
    while i < n:
        tag = page.tags[i]
        mark = f"{page.attrs[i].get('class') or ''} {page.attrs[i].get('id') or ''}".lower()
        if tag in BOILERPLATE or (mark != " " and tag not in ("html", "body", "main", "article") and ADS.search(mark)):
            i = page.ends[i]
            continue
        if tag in ("p", "pre", "td", "blockquote"):
            length = page.length(i)
            if length >= 25 and page.linked(i) < 0.5 * length:
                points = 1 + page.commas(i) + min(length // 100, 3)
                parent = page.parents[i]
                for holder, share in ((parent, 1.0), (page.parents[parent], 0.5)):
                    if holder >= 0:
                        scores[holder] = scores.get(holder, 0) + points * share
        i += 1
    if not scores:
        return None
    best = max(scores, key=lambda k: scores[k])
    least = max(10.0, 0.2 * scores[best])
    parts, i = [], page.parents[best] + 1  # the first child of best's parent; 0 if best is the page
    while i < (page.ends[page.parents[best]] if best else 1):
        if i == best or scores.get(i, 0) >= least or _prose(page, i):
            parts.append(page.clean_of(i))
        i = page.ends[i]
    text = collapse("".join(parts))
    return (title_of(page), text) if text else None


def _prose(page: Page, i: int) -> bool:
    if page.tags[i] != "p":
        return False
    length = page.length(i)
    if length > 80:
        return page.linked(i) < 0.25 * length
    return length > 0 and not page.linked(i) and bool(re.search(r"\.( |$)", collapse(page.clean_of(i))))


def extract(html: str | None, page: Page | None = None) -> tuple[str | None, str, bool]:
    """(title, text, whether the reader found an article)."""
    page = page or parse(html)
    found = readable(page)
    if found and len(found[1]) >= LEAST_READABLE:
        return found[0], found[1], True
    return (found[0] if found and found[0] else title_of(page)), plain(page), False


def tables(html: str | None, page: Page | None = None) -> list[dict]:
    """Caption, headers and rows of every table with more than one column. A table also has the rows and cells of the tables inside it; where that
    would be more than MOST_CELLS cells or MOST_TEXT characters, every row, cell and text is given to the innermost table alone."""
    page = page or parse(html)
    found = [t for t in page.of("table")]
    if not found:
        return []
    every, cells = page.of("tr"), page.of("th", "td")
    sizes = [0, *accumulate(b - a for a, b in (page.spans[i] for i in cells))]
    range_of = {r: (bisect_right(cells, r), bisect_left(cells, page.ends[r])) for r in every}
    counts = [0, *accumulate(b - a for a, b in range_of.values())]
    texts = [0, *accumulate(sizes[b] - sizes[a] for a, b in range_of.values())]
    whole = [(bisect_right(every, t), bisect_left(every, page.ends[t])) for t in found]
    own = sum(counts[b] - counts[a] for a, b in whole) > MOST_CELLS or sum(texts[b] - texts[a] for a, b in whole) > MOST_TEXT
    if own:
        rows_of, cells_of, inner = {}, {}, {}
        for r in every:
            rows_of.setdefault(page.around[r][0], []).append(r)
        for x in cells:
            cells_of.setdefault(page.around[x][3], []).append(x)
        holders = sorted(cells)
        for t in _tops(page, found, holders):
            inner.setdefault(t[1], []).append(t[0])
    made: dict[int, list[str]] = {}

    def cells_in(row: int) -> list[str]:
        if row not in made:
            if own:
                made[row] = [collapse(_without(page, x, inner.get(x, []))) for x in cells_of.get(row, [])]
            else:
                made[row] = [collapse(page.text_of(x)) for x in cells[slice(*range_of[row])]]
        return made[row]

    captions: dict[int, str] = {}
    for i in page.of("caption"):
        captions.setdefault(page.parents[i], collapse(page.text_of(i)))
    out = []
    for t, (a, b) in zip(found, whole):
        rows = rows_of.get(t, []) if own else every[a:b]
        if not rows:
            continue
        heads = [r for r in rows if page.around[r][1] > t]
        if len(rows) > 1 and not heads and all(r + 1 < page.ends[r] and page.tags[r + 1] == "th" for r in rows):
            headers, body = [], rows
        elif heads:
            headers = cells_in(heads[0])
            body = [r for r in rows if page.around[r][2] > t] or [r for r in rows if page.around[r][1] <= t]
        else:
            headers, body = cells_in(rows[0]), rows[1:]
        data = [x for x in map(cells_in, body) if x]
        if len(headers) <= 1 and all(len(x) <= 1 for x in data):
            continue
        out.append({"caption": captions.get(t) or None, "headers": headers, "rows": data})
    return out


def _tops(page: Page, some: list[int], holders: list[int]):
    """(table, the innermost cell around it) of tables inside cells."""
    stack: list[int] = []
    at = 0
    for t in some:
        while at < len(holders) and holders[at] < t:
            stack.append(holders[at])
            at += 1
        while stack and page.ends[stack[-1]] <= t:
            stack.pop()
        if stack:
            yield t, stack[-1]


def _without(page: Page, i: int, some: list[int]) -> str:
    """The text of an element but for that of some elements below it, of which none lies in another."""
    at, out = page.spans[i][0], []
    for k in _outermost(page, some):
        out.append(page.text[at : page.spans[k][0]])
        at = page.spans[k][1]
    return "".join([*out, page.text[at : page.spans[i][1]]])


def _anchors(page: Page):
    return ((page.attrs[i]["href"], i) for i in page.of("a") if page.attrs[i].get("href") is not None)


def same_host_links(html: str | None, url: str | None, page: Page | None = None) -> list[str]:
    """Distinct links to the page's own host (port included), in document order."""
    own = host_of(resolve(None, url))
    found = (resolve(url, href) for href, _ in _anchors(page or parse(html)))
    return list(dict.fromkeys(x for x in found if x and own and host_of(x) == own))


def document_links(html: str | None, url: str | None, page: Page | None = None) -> list[dict]:
    """Links to downloadable documents, each address once with its first text."""
    out: dict[str, dict] = {}
    if not url:
        return []
    page = page or parse(html)
    for href, i in _anchors(page):
        link = resolve(url, href)
        path = re.sub(r"^[a-z]+://[^/]*|\?.*$", "", link or "")
        kind = path.rpartition(".")[2].lower() if "." in path else ""
        if link and kind in DOCUMENT_EXTENSIONS and link not in out:
            out[link] = {"url": link, "text": collapse(page.text_of(i)), "type": kind}
    return list(out.values())
