"""The main text of web pages by tag-path ratios.

A page is read into blocks: the text between two block-level tags, with the path of block-level elements around it. For each path the
page's blocks are added up: their number, code points, punctuation marks and code points inside of links. Ratios of these are fused into
one figure for a path: text for each block, punctuation for each block, share outside of links; paths under an element that is no part of an
article by its tag, role or name (menus, forms, comments, notices, ...) have none. The element path that holds most of the fused weight
is the page's centre. Figures are smoothed from there: a path below the centre takes over the centre's greatest figure, so that headings and short lines among
long paragraphs stay; paths elsewhere keep their own. Blocks of paths over a threshold are the main text.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, rows_of

# Elements of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style title textarea noscript template iframe noframes noembed xmp svg object canvas audio video head".split())
NESTING = frozenset("noscript template svg object canvas audio video".split())  # of these, one that is not ended is passed over
HIDDEN = frozenset("nav aside footer button select option fieldset dialog menu search legend optgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
#: Elements that a start tag ends if they are open, and those at which the search for them ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
#: Words of an element's class or id by which it is no part of an article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer header masthead topbar toolbar comment comments commentlist reply replies respond disqus discussion related recommended recommendations share sharing social "
    "pagination pager search form copyright disclaimer skip".split()
)

#: Such words may have one of these joined to them: cookiebar, commentlist, adslot, topnav.
_NAMED = re.compile(
    rf"(?:top|side|left|right|main|sub|site|page)?(?:{'|'.join(sorted(NAMES, key=len, reverse=True))})(?:bar|box|list|section|area|thread|form|slot|unit|block|space|banner|notice|wrap|wrapper|container|links|items?|trail)?"
)

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(!--)|([!?/]))")
_NAME = re.compile(r"</?[a-zA-Z]")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？«»“”„¿¡]")
#: Share of the greatest figure that a path's own must reach outside of the centre, share of all weight that the centre holds, share of
#: link text from which a path is a list of links.
THRESHOLD, CENTRE, LINKS = 0.3, 0.6, 0.6


@functools.lru_cache(1 << 14)
def _named(word: str) -> bool:
    return _NAMED.fullmatch(word) is not None


class _Element:
    __slots__ = ("name", "path", "above", "by_tag", "by_name", "holds")

    def __init__(self, name: str, path: int, above: _Element | None, by_tag: bool, by_name: bool):
        self.name, self.path, self.above, self.by_tag, self.by_name, self.holds = name, path, above, by_tag, by_name, False


class Page:
    """A page's blocks: texts in page order, each with its element and how many of its code points are in links."""

    def __init__(self, source: str):
        self.paths: dict[tuple[int, str], int] = {}
        self.above: list[int] = []  # the path above each path
        self.elements: list[_Element] = []
        self.open: list[_Element] = []
        self.counts: dict[str, int] = {}
        self.blocks: list[tuple[str, _Element | None, int]] = []
        self.text: list[str] = []
        self.linked = 0
        self.in_link = False
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at, seek, last = 0, 0, source.rfind(">")
        endless: set[str] = set()  # elements without an end tag from here on
        while True:
            begin = source.find("<", seek)
            if begin < 0:
                self._words(source[at:])
                return
            tag = _NAME.match(source, begin)
            if tag and begin > last:  # a tag that does not end is no text
                self._words(source[at:begin])
                return
            m = _TAG.match(source, begin) or (_LOOSE.match(source, begin) if tag else None)  # one with a quote that does not end: it ends at the next >
            if m is None:  # a lone < is text
                seek = begin + 1
                continue
            self._words(source[at:begin])
            at = m.end()
            if m.re is _TAG and m[4]:
                short = re.match(r"-?>", source[at : at + 2])
                end = source.find("-->", at)
                at = at + short.end() if short else end + 3 if end >= 0 else len(source)
            elif m.re is _TAG and m[5]:
                end = source.find(">", at)
                at = end + 1 if end >= 0 else len(source)
            elif m[1]:
                self._end(m[2].lower())
            else:
                name = m[2].lower()
                if name in RAW and not (m[3].endswith("/") and name in ("svg", "object")):
                    if name == "head":
                        end = re.compile(r"</head\b[^>]*>|<body\b", re.I).search(source, at)
                        at = seek = len(source) if end is None else end.end() if end[0][1] == "/" else end.start()
                        continue
                    end = None if name in endless else re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    if end is None:
                        endless.add(name)
                    at = end.end() if end else at if name in NESTING else len(source)
                    if name not in ("script", "style", "template"):
                        self.text.append(" ")
                else:
                    self._start(name, m[3])
            seek = at

    def _words(self, piece: str) -> None:
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            self.text.append(piece)
            if self.in_link:
                self.linked += len("".join(piece.split()))

    def _flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((text, self.open[-1] if self.open else None, self.linked))
            self.text = []
        self.linked, self.in_link = 0, False

    def _start(self, name: str, attributes: str) -> None:
        if name == "a":
            self.in_link = True
        elif name == "br":
            self.text.append(" ")
        if name not in BLOCKS:
            return
        self._flush()
        if name == "hr" or name in ("html", "body") and self.counts.get(name):
            return
        if self.open and self.open[-1].name == "p":
            self._pop()
        if name in CLOSES:
            ends, stops = CLOSES[name]
            if any(self.counts.get(x) for x in ends):
                for k in range(len(self.open) - 1, -1, -1):
                    if self.open[k].name in stops:
                        break
                    if self.open[k].name in ends:
                        while len(self.open) > k:
                            self._pop()
                        break
        words, by_tag = [], name in HIDDEN
        if attributes and "=" in attributes:
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), (a or b or c).lower()
                if key in ("class", "id"):
                    words += re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", a or b or c).lower())
                elif key == "role":
                    by_tag |= value in ROLES
                elif key == "aria-hidden":
                    by_tag |= value == "true"
                elif key == "style":
                    by_tag |= re.search(r"(display\s*:\s*none|visibility\s*:\s*hidden)", value) is not None
        if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes), re.I):
            by_tag = True
        inside = self.counts.get("article", 0) + self.counts.get("main", 0) > 0
        by_name = name == "form" or name not in ("html", "body", "main") and any(_named(w) and not (inside and w.endswith("header")) for w in words)
        by_tag |= name == "header" and not inside
        above = self.open[-1] if self.open else None
        key = (above.path if above else -1, ".".join([name, *sorted(set(words))]))
        if key not in self.paths:
            self.paths[key] = len(self.above)
            self.above.append(key[0])
        e = _Element(name, self.paths[key], above, by_tag, by_name and name not in HEADINGS)
        if name in ("article", "main") or name == "h1":
            up = above
            while up is not None and not up.holds:
                up.holds, up = True, up.above
        self.elements.append(e)
        self.open.append(e)
        self.counts[name] = self.counts.get(name, 0) + 1

    def _pop(self) -> None:
        self.counts[self.open.pop().name] -= 1

    def _end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        if name not in BLOCKS:
            return
        self._flush()
        if self.counts.get(name):
            while self.open[-1].name != name:
                self._pop()
            self._pop()


def chosen(page: Page) -> list[str]:
    """The blocks of the page's main text, in page order."""
    no_part: dict[int, bool] = {}
    for e in page.elements:  # an element stands after the one around it
        no_part[id(e)] = (e.above is not None and no_part[id(e.above)]) or e.by_tag or (e.by_name and not e.holds)
    left = [(text, e, linked) for text, e, linked in page.blocks if e is None or not no_part[id(e)]]
    if not left:
        return []
    at = lambda e: -1 if e is None else e.path
    # aggregate by path
    n, chars, marks, links = {}, {}, {}, {}
    for text, e, linked in left:
        p = at(e)
        n[p] = n.get(p, 0) + 1
        chars[p] = chars.get(p, 0) + len(text)
        marks[p] = marks.get(p, 0) + len(_PUNCTUATION.findall(text))
        links[p] = links.get(p, 0) + linked
    # fuse
    share = {p: min(1.0, links[p] / max(1, chars[p])) for p in n}
    figure = {p: chars[p] / n[p] * (1 + marks[p] / n[p]) * (1 - share[p]) ** 2 for p in n}
    most = max(figure.values())
    # the centre: the lowest path, above a text's own, that holds most of the weight
    weight = [0.0] * len(page.above)
    names = {e.path: e.name for e in page.elements}
    for p in n:
        if p >= 0 and page.above[p] >= 0:
            weight[page.above[p]] += chars[p] * figure[p]
    for p in range(len(page.above) - 1, -1, -1):  # a path stands after the one around it
        if page.above[p] >= 0:
            weight[page.above[p]] += weight[p]
    whole = sum(chars[p] * figure[p] for p in n)
    outer = lambda p: p < 0 or names[p] in ("html", "body")
    centre = max((p for p in range(len(weight)) if weight[p] >= CENTRE * whole and not outer(p)), default=None) if whole else None
    if centre is not None:
        up = centre  # the outermost article or main element around it, else one more step if that brings a heading in
        marked = None
        while up >= 0:
            if names[up] in ("article", "main"):
                marked = up
            up = page.above[up]
        if marked is not None:
            centre = marked
        else:
            with_heading = {page.above[p] for p in n if p >= 0 and names[p] in ("h1", "h2")}
            with_heading |= {page.above[p] for p in with_heading if p >= 0}
            if centre not in with_heading and page.above[centre] in with_heading and not outer(page.above[centre]):
                centre = page.above[centre]
    # smooth
    below = [False] * len(page.above)
    for p in range(len(page.above)):
        below[p] = p == centre or (page.above[p] >= 0 and below[page.above[p]])
    top = max((figure[p] for p in n if p >= 0 and below[p]), default=0.0)
    flat = centre is None and any(p >= 0 and outer(page.above[p]) for p in n if figure[p] == most)  # paragraphs right below the body

    def smooth(p: int) -> float:
        if share[p] > LINKS and not (p >= 0 and names[p] in HEADINGS):  # a title is often a link
            return 0.0
        if p >= 0 and below[p]:
            return max(figure[p], top)
        if flat and (p < 0 or (outer(page.above[p]) and names[p] in (*HEADINGS, "p", "pre"))):
            return most
        return figure[p]

    # threshold
    keep = {p: (f := smooth(p)) > 0 and f >= THRESHOLD * most for p in n}
    return [text for text, e, _ in left if keep[at(e)]]


def main_text(source: str | None) -> str:
    return "\n".join(chosen(Page(source))) if source else ""


_ARROW = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for key, url, source in rows_of(b):
                text = main_text(source)
                yield key, url, text, len(text)

    yield from in_chunks(rows(), _ARROW, most=256)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (its code points).

    White space inside a block is one space, blocks are joined by one line end. Null and empty pages, and pages without main text, have an
    empty text; what is no HTML is one block. Pages are read whole, however long, in time in proportion to their length. Repeated rows stay
    repeated, an empty table stays empty, other columns are not read. Nothing is shuffled.
    """
    named = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return named.mapInArrow(_extracting, "id long, url string, text string, n_chars long")
