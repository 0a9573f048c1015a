"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path of block-level tags from the root. For
every path, text length, punctuation and linked text are summed over its blocks and divided
by their number, so a short paragraph counts as much as the long ones beside it. These ratios
are smoothed over neighbouring blocks, where a neighbour weighs less the more edits lie
between the two paths, and fused by multiplication. Blocks whose value reaches a share of the
page's mean are the content. Elements that name themselves as menus, notices and the like are
never content; words and tags only veto.

Paths are numbered by parent and tag, what an element hands down is kept on a stack, and ends
of tags are looked up once, so time and memory grow with the length of the page however deep
or broken it is.

Null html counts as empty, and a page without text gives an empty string. Rows are
independent: one narrow pass, no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.bpe import small_batches

#: Share of the page's mean fused ratio that makes a block content.
THRESHOLD = 0.1
#: Neighbours on each side that smooth a block, and edits between paths beyond which they don't.
NEAR, FAR = 2, 4

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<tag>[a-zA-Z][^\s/>]*)|(?P<text>[^<]+|<)", re.S
)
STOP = re.compile(r"[>\"']")
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noframes xmp iframe".split())
#: Elements that never hold article text.
DROPPED = set("nav footer aside form script style noscript button select template iframe dialog menu textarea title head svg object canvas audio video map datalist".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Opening one of these closes an open paragraph.
CLOSES_P = BLOCK - set("br caption body html head option select title tr td th tbody thead tfoot legend".split())
#: What an element closes if it is open, and where the search ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
#: Words in class, id or role of parts that are not the article.
MARKED = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promotion sidebar sidebars menu menus nav navbar "
    "navigation topnav subnav breadcrumb breadcrumbs footer footers comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices "
    "alert alerts popup modal overlay newsletter subscribe subscription signup signin login share sharing social related recommended recommendations widget widgets toolbar "
    "pagination pager skip copyright legal disclaimer search contentinfo complementary dialog form forms masthead topbar bottombar paywall tooltip hidden".split()
)
#: The same, but only outside the article itself.
HEADERS = {"header", "headers", "head"}
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？·—–|()«»„“”\"']")
INLINE_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Element(NamedTuple):
    """An open element: its path, and what holds for all text in it."""

    tag: str
    path: int
    dropped: bool
    article: bool
    linked: bool


class Block(NamedTuple):
    path: int
    text: str
    linked: int
    dropped: bool


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(text)}


def _vetoed(tag: str, attrs: str, article: bool) -> bool:
    found = _attributes(attrs) if attrs.strip() else {}
    label = " ".join(found.get(x, "") for x in ("class", "id", "role"))
    words = {w.lower() for w in CAMEL.findall(label)} | {w.lower() for w in re.split(r"[\s_-]+", label)}
    own = tag in ("article", "main", "body", "html")
    return (
        tag in DROPPED or (not own and bool(words & MARKED)) or (not article and not own and (tag == "header" or bool(words & HEADERS)))
        or "hidden" in found or found.get("aria-hidden") == "true" or bool(INLINE_HIDDEN.search(found.get("style", "")))
    )


class Page:
    """The blocks of a page in order, and the table of its paths."""

    def __init__(self, page: str):
        self.page = page
        #: Parent and depth of each path; a path is a parent path and a tag.
        self.parent, self.depth, self._number = [0], [0], {}
        self.stack = [Element("", 0, False, False, False)]
        self.open: Counter = Counter()
        self._ends: dict[int, int] = {}
        self.blocks: list[Block] = []
        self._parts: list[tuple[Element, str]] = []
        self._read()

    def _path(self, parent: int, tag: str) -> int:
        if (parent, tag) not in self._number:
            self._number[parent, tag] = len(self.parent)
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
        return self._number[parent, tag]

    def _tag_end(self, at: int) -> int:
        """Place of the mark that closes a tag, outside quotes, or -1; every stop between quotes is looked up once."""
        trail = []
        while at not in self._ends:
            trail.append(at)
            m = STOP.search(self.page, at)
            if not m or m[0] == ">":
                self._ends[at] = m.start() if m else -1
                break
            close = self.page.find(m[0], m.end())
            if close < 0:
                self._ends[at] = -1
                break
            at = close + 1
        found = self._ends[at]
        self._ends.update(dict.fromkeys(trail, found))
        return found

    def _close(self, size: int) -> None:
        while len(self.stack) > size:
            self.open[self.stack.pop().tag] -= 1

    def _flush(self) -> None:
        """Text since the last border of a block; parts under different vetoes are blocks of their own."""
        for dropped in (False, True):
            parts = [(e, t) for e, t in self._parts if e.dropped == dropped]
            text = " ".join("".join(t for _, t in parts).split())
            if text:
                linked = sum(len(" ".join(t.split())) for e, t in parts if e.linked)
                self.blocks.append(Block(next(e.path for e, t in parts if t.strip()), text, min(linked, len(text)), dropped))
        self._parts = []

    def _implied(self, tag: str) -> None:
        """Closes what this tag closes, such as an open paragraph or list item."""
        closed, stop = CLOSES.get(tag, (set(), set()))
        p = tag in CLOSES_P
        if not (p and self.open["p"] or any(self.open[t] for t in closed)):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.stack[k].tag
            if t in stop or t in ("button", "caption", "object"):
                return
            if t in closed or p and t == "p":
                self._close(k)
                if t == "p":
                    return
                # Of cells and rows the outermost one closes.
                if k == 1 or not closed & {e.tag for e in self.stack[max(1, k - 3) : k]}:
                    return
            elif t in ("td", "th", "table", "article", "div", "section", "li") and not closed:
                return

    def _start(self, tag: str, attrs: str) -> None:
        up = self.stack[-1]
        article = up.article or tag in ("article", "main")
        path = self._path(up.path, tag) if tag in BLOCK else up.path
        self.stack.append(Element(tag, path, up.dropped or _vetoed(tag, attrs, article), article, up.linked or tag == "a"))
        self.open[tag] += 1

    def _read(self) -> None:
        page, pos, no_end = self.page, 0, False
        while pos < len(page):
            m = TOKEN.match(page, pos)
            pos = m.end()
            if m["tag"]:
                tag, end = m["tag"].lower(), self._tag_end(pos)
                plain = end < 0  # a quote stays open: the tag ends at the next mark, without attributes
                if plain and not no_end:
                    end = page.find(">", pos)
                    no_end = end < 0
                if end < 0:
                    pos = m.start() + 1
                    self._parts.append((self.stack[-1], "<"))
                    continue
                attrs, pos = "" if plain else page[pos:end], end + 1
                if tag in BLOCK:
                    self._flush()
                if tag in BLOCK or tag in CLOSES:
                    self._implied(tag)
                if tag in VOID:
                    continue
                if tag in RAW:
                    found = _raw_end(tag).search(page, pos)
                    pos = found.end() if found else len(page)
                elif not attrs.rstrip().endswith("/") or tag not in ("path", "circle", "rect", "use", "g"):
                    self._start(tag, attrs)
            elif m["end"]:
                tag = m["end"].lower()
                if tag in BLOCK:
                    self._flush()
                if self.open[tag]:
                    k = len(self.stack) - 1
                    while self.stack[k].tag != tag:
                        k -= 1
                    self._close(k)
            elif m["text"] or m["cdata"]:
                self._parts.append((self.stack[-1], html.unescape(m["text"] or m["cdata"])))
        self._flush()

    def edits(self, a: int, b: int) -> int:
        """Edits between two paths, counted up to FAR: tags below their common part, replaced, or added on one side."""
        if abs(self.depth[a] - self.depth[b]) > FAR:
            return FAR + 1
        steps = 0
        while a != b and steps <= FAR:
            steps += 1
            deeper, other = self.depth[a], self.depth[b]
            a = self.parent[a] if deeper >= other else a
            b = self.parent[b] if other >= deeper else b
        return steps


_RAW_ENDS: dict[str, re.Pattern] = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


def _raw_end(tag: str) -> re.Pattern:
    return _RAW_ENDS[tag]


def values(page: Page) -> list[float]:
    """Fused ratio of every block that isn't vetoed, as a share of their mean."""
    live = [b for b in page.blocks if not b.dropped]
    sums: dict[int, list[int]] = {}
    for b in live:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        s[0] += len(b.text)
        s[1] += len(PUNCTUATION.findall(b.text))
        s[2] += b.linked
        s[3] += 1
    ratio = {p: (n / k, (1 + marks) / k, 1 - linked / n) for p, (n, marks, linked, k) in sums.items()}
    weight = [math.exp(-d * d / 2) for d in range(FAR + 2)]
    out = []
    for k, b in enumerate(live):
        total, fused = 0.0, [0.0, 0.0, 0.0]
        for other in live[max(0, k - NEAR) : k + NEAR + 1]:
            w = weight[page.edits(b.path, other.path)]
            total += w
            for x, r in enumerate(ratio[other.path]):
                fused[x] += w * r
        out.append(math.prod(x / total for x in fused) * ratio[b.path][2])
    mean = sum(out) / len(out) if out else 0
    return [v / mean if mean else 1.0 for v in out]


def main_text(page: str | None) -> str:
    """Text of the content blocks of one page."""
    if not page:
        return ""
    found = Page(page)
    live = [b for b in found.blocks if not b.dropped]
    return " ".join(b.text for b, v in zip(live, values(found)) if v >= THRESHOLD)


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """All columns but the html, and ``text, n_chars``."""
    names = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    held = pages.select(F.col(html_column).cast("string").alias("html"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    kinds = "".join(f"c{i} {held.schema[f'c{i}'].dataType.simpleString()}, " for i in range(len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            found = [main_text(p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=[*(f"c{i}" for i in range(len(names))), "text", "n_chars"]
            )

    rows = held.mapInArrow(run, f"{kinds}text string, n_chars bigint")
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "text", "n_chars")
