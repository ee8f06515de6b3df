"""Main text of HTML pages by text-to-tag ratio.

A linear pass puts the markup in order: comments, declarations and raw contents go,
tags keep the few attributes that are read, and markup that never ends runs to the
end of the page.  Events of the standard library's streaming parser then build
lines: one for each block of text, with its characters, the tags and the link
characters in it, and the element it stands in.

The logarithm of a line's text-to-tag ratio is smoothed by a Gaussian over the
neighbouring lines.  What stands around a line weighs: an article or main element
speaks for it, and an element that announces something else by its tag, role,
class or id (menus, headers, footers, asides, forms, adverts, notices, comments)
speaks against it, both in the smoothing (such a line says little about its
neighbours) and in the level that comes of it.  Lines whose level is at or above a
share of the standard deviation of all levels of the page form the clusters; the
clusters, in page order, are the text.  Link characters count for as much as the list or
element around the line holds text that is no link, and fully within an article.

A form or a wrapper with a telling name does not speak against the page that it
holds: not if a main element or a long article stands in it, nor if most of the
clustered text does.

Edge cases: null and empty pages, and pages without text, give an empty text;
broken markup is read as the parser reads it, open elements end with the page;
text without any markup is one line; repeated rows are read one by one; time is
linear in the page, whatever its markup.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Width of the Gaussian in lines, share of the standard deviation that clusters start at, and the least level of one.
SIGMA, SHARE, FLOOR = 1.0, 0.25, 0.3
#: Weights of a line that stands in something else, and in an article or main element; others weigh 1.
BESIDE, ARTICLE = 0.02, 3.0
#: Share of clustered text above which a form or a telling name does not speak against an element.
MOST = 0.5

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page.
_SILENT = frozenset("script style noscript template head title svg iframe object canvas video audio map select textarea button datalist noframes".split())
#: Elements whose content is not read as markup; none of it is text of the page.
_RAW = frozenset("script style textarea title iframe noembed noframes".split())
_ASIDE_TAGS = frozenset("nav footer aside form menu dialog search".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist tooltip".split())
#: Words of a class or id that speak against an element anywhere, and those that do so only outside articles and mains.
_ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs pagination pager footer sidebar sidebars sidenav "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments commentlist disqus respond reply replies share sharing".split()
)
_OUTSIDE_WORDS = frozenset("banner toolbar topbar masthead header rail alert discussion social related recommended recommendations widget widgets copyright legal disclaimer form search".split())
#: First words of classes that tell what stands beside an element, not what it is.
_STATE_WORDS = frozenset("has no not with without".split())
#: How an element speaks against its lines: by its own kind, or by a guess from form and names.
_KIND, _GUESS = 1, 2
_LISTS = frozenset("ul ol dl dir table".split())
#: Elements whose links are weighed by the list or table around them.
_ENTRIES = frozenset("li dt dd td th tr tbody thead tfoot caption".split())
#: Elements of one paragraph, whose links are weighed by the element around them; those of others by the element itself.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre".split())
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Start tags that end an open element, up to the nearest of the listed holders.
_ENDS = {name: (ends.split(), stop.split()) for name, ends, stop in (
    ("li", "li", "ul ol menu dir"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table thead tbody tfoot"),
    ("td", "td th", "tr table"), ("th", "td th", "tr table"), ("option", "option", "select datalist optgroup"),
)}
_P_ENDS = (["p"], "table button object td th article section div li".split())
#: A whole tag; a quoted value only after an equals sign.  Possessive, so that a failure is not tried again in other ways.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_READ = frozenset("class id role hidden aria-hidden style".split())


def _names(value: str) -> Iterator[str]:
    """Words of a class or id."""
    for name in value.split():
        words = _WORD.findall(_CAMEL.sub(" ", name).lower())
        if words and words[0] not in _STATE_WORDS:
            yield from words


def _against(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> int:
    """Whether and how an element announces that it is not main text; ``inside``: it stands in an article or main element."""
    if tag in _ASIDE_TAGS or tag == "header" and not inside:
        return _GUESS if tag == "form" else _KIND
    if tag in ("html", "body", "article", "main"):
        named = [v for k, v in attrs if k in ("class", "id") and v] if tag == "article" else []
        return _KIND * any(w in ("comment", "comments", "reply") for v in named for w in _names(v))
    found = 0
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and _HIDDEN.search(v):
            return _KIND
        if v and k == "role" and v.lower() in _ASIDE_ROLES:
            if v.lower() != "form":
                return _KIND
            found = _GUESS
        if v and k in ("class", "id") and any(w in _ASIDE_WORDS or not inside and w in _OUTSIDE_WORDS for w in _names(v)):
            found = _GUESS
    return found


def tidy(html: str) -> str:
    """The page with simple, whole tags only, in one pass.

    Comments, declarations and raw contents are left out; a tag keeps the attributes that are read.
    As in browsers, a comment, a tag or a raw element that never ends runs to the end of the page.
    """
    out: list[str] = []
    i = 0
    while (j := html.find("<", i)) >= 0:
        out.append(html[i:j])
        if html.startswith("<!--", j):
            i = html.find("-->", j + 2) + 3
            if i < 3:
                return "".join(out)
            continue
        c = html[j + 1 : j + 2]
        letter = html[j + 2 : j + 3] if c == "/" else c
        if letter.isascii() and letter.isalpha():
            m = _TAG.match(html, j)
            if not m:
                return "".join(out)
            i, tag = m.end(), m[2].lower()
            if m[1]:
                out.append(f"</{tag}>")
                continue
            kept = []
            for a in _ATTRIBUTE.finditer(m[3]) if m[3] else ():
                if (name := a[1].lower()) in _READ:
                    kept.append(f' {name}="{(a[2] or a[3] or a[4] or "").replace(chr(34), "&quot;")}"')
            out.append(f"<{tag}{''.join(kept)}>")
            if tag in _RAW:
                end = _RAW_END[tag].search(html, i)
                if not end:
                    return "".join(out)
                i = end.start()
        elif c and c in "!?/":
            i = html.find(">", j + 2) + 1
            if not i:
                return "".join(out)
        else:
            out.append("&lt;")
            i = j + 1
    out.append(html[i:])
    return "".join(out)


_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in _RAW}


@dataclass
class Line:
    text: str
    chars: int
    tags: int
    links: int
    node: int


@dataclass
class _Open:
    tag: str
    node: int
    silent: bool
    inside: bool


@dataclass
class _Parser(HTMLParser):
    """Collects lines and the tree of block elements and those that speak against their lines (parent, tag and mark of each)."""

    lines: list[Line] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.mark = [-1], ["#page"], [0]
        self.stack = [_Open("#page", 0, False, False)]
        self.at: dict[str, list[int]] = defaultdict(list)  # places of the open elements of each tag
        self.blocks = [0]  # and of all open blocks
        self.parts: list[str] = []
        self.tags = self.links = 0

    def _flush(self) -> None:
        words = "".join(self.parts).split()
        if words:
            self.lines.append(Line(" ".join(words), sum(map(len, words)), self.tags, self.links, self.stack[-1].node))
        self.parts, self.tags, self.links = [], 0, 0

    def _close(self, index: int) -> None:
        while len(self.stack) > index:
            tag = self.stack.pop().tag
            self.at[tag].pop()
            if tag in _BLOCKS:
                self.blocks.pop()

    def _last(self, tags: list[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _end(self, ends: list[str], stop: list[str]) -> None:
        """Close the nearest of ``ends`` unless one of ``stop`` is nearer."""
        i = self._last(ends)
        if i > self._last(stop):
            self._close(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        block = tag in _BLOCKS
        if block:
            self._flush()
            self.tags = 1
            self._end(*_ENDS.get(tag, _P_ENDS))
        elif tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        if tag == "body":
            self._end(["head"], [])
        top = self.stack[-1]
        node = top.node
        mark = _against(tag, attrs, top.inside)
        if block or mark:
            node = len(self.parent)
            self.parent.append(top.node)
            self.tag.append(tag)
            self.mark.append(mark)
        self.at[tag].append(len(self.stack))
        if block:
            self.blocks.append(len(self.stack))
        self.stack.append(_Open(tag, node, top.silent or tag in _SILENT, top.inside or tag in ("article", "main")))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        block = tag in _BLOCKS
        if block:
            self._flush()
        i = self._last([tag])
        if i and (block or i > self.blocks[-1]):  # an inline end tag does not end blocks
            self._close(i)

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].silent:
            self.parts.append(data)
            if self.at.get("a"):
                self.links += sum(map(len, data.split()))


def parse(html: str) -> _Parser:
    p = _Parser()
    p.feed(tidy(html))
    p.close()
    p._flush()
    return p


def smooth(x: np.ndarray, weight: np.ndarray | None = None, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over neighbouring lines, each counting by its weight."""
    weight = np.ones(len(x)) if weight is None else weight
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    own = slice(reach, reach + len(x))
    return np.convolve(x * weight, kernel)[own] / np.convolve(weight, kernel)[own]


def clusters(ratio: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Lines whose weighed and smoothed log ratio is at or above the threshold."""
    level = weight * smooth(np.log1p(ratio), weight)
    return (level >= max(FLOOR, SHARE * level.std())) & (ratio > 0)


def _below(p: _Parser, own: np.ndarray) -> np.ndarray:
    """Sums over the lines in and below each element."""
    total = np.zeros(len(p.parent))
    np.add.at(total, [x.node for x in p.lines], own)
    for i in range(len(total) - 1, 0, -1):
        total[p.parent[i]] += total[i]
    return total


def ratios(p: _Parser) -> np.ndarray:
    """Text characters per tag of each line, link characters counting by the share of other text around them."""
    chars, links = np.array([x.chars for x in p.lines], float), np.array([x.links for x in p.lines], float)
    share = 1 - _below(p, links) / np.maximum(_below(p, chars), 1)
    lists, inside, weigh = [0], [False], [0]  # the list or table around each element, whether it stands in an article or main, and whose share holds for it
    for i in range(1, len(p.parent)):
        lists.append(i if p.tag[i] in _LISTS else lists[p.parent[i]])
        inside.append(inside[p.parent[i]] or p.tag[i] in ("article", "main"))
        weigh.append(lists[i] if p.tag[i] in _ENTRIES else p.parent[i] if p.tag[i] in _LEAVES else i)
    counts = np.array([1.0 if inside[x.node] else share[weigh[x.node]] for x in p.lines])
    return (chars - links * (1 - counts)) / np.array([max(1, x.tags) for x in p.lines])


def weights(p: _Parser, ratio: np.ndarray) -> np.ndarray:
    """Weight of each line by the elements around it."""
    mark, n = list(p.mark), len(p.parent)
    clustered = clusters(ratio, np.ones(len(p.lines)))
    weight = _below(p, np.array([x.chars for x in p.lines]) * clustered)

    def spread(own: list) -> list[bool]:
        out = [bool(own[0])]
        for i in range(1, n):
            out.append(out[p.parent[i]] or bool(own[i]))
        return out

    holders = [i for i, t in enumerate(p.tag) if t in ("article", "main") and not mark[i] and weight[i] > 0]
    if any(mark):
        gone = spread(mark)
        kind, comment = spread([m == _KIND for m in mark]), spread([t == "article" and m for t, m in zip(p.tag, mark, strict=True)])
        free = max((weight[i] for i in holders if not gone[i]), default=0)
        rest = sum(x.chars for x, ok in zip(p.lines, clustered, strict=True) if ok and not gone[x.node])
        holds = [False] * n  # a main element, or an article longer than what stands free
        for i in holders:
            holds[i] = not comment[i] and (p.tag[i] == "main" or weight[i] >= (max(free, rest) if kind[i] else free))
        for i in range(n - 1, 0, -1):
            holds[p.parent[i]] |= holds[i]
        mark = [0 if h else m for h, m in zip(holds, mark, strict=True)]
        gone = spread(mark)
        if all(gone[i] for i in holders):
            mark = [0 if m == _GUESS and w > MOST * weight[0] else m for m, w in zip(mark, weight, strict=True)]
    gone, inside = spread(mark), spread([t in ("article", "main") for t in p.tag])
    return np.array([BESIDE if gone[x.node] else ARTICLE if inside[x.node] else 1.0 for x in p.lines])


def main_text(html: str | None) -> str:
    """The main text of a page: blocks in page order, one a line."""
    p = parse(html or "")
    if not p.lines:
        return ""
    ratio = ratios(p)
    return "\n".join(x.text for x, ok in zip(p.lines, clusters(ratio, weights(p, ratio)), strict=True) if ok)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars`` (code points) of every page; no shuffle."""
    keep = ["page_id", "url"] if keep is None else keep
    names = [f"c{i}" for i in range(len(keep))]
    frame = pages.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)), F.col(html).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "h"):
            text = [main_text(h) for h in b.column("h").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*names, "text", "n_chars"])

    types = dict(frame.dtypes)
    out = frame.mapInArrow(run, ", ".join([*(f"{n} {types[n]}" for n in names), "text string, n_chars bigint"]))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "text", "n_chars")
