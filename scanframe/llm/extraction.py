"""HTML extraction: the main text of a page by composite text density.

A page is read into an array of nodes, each after its parent. Every node's composite density
is its characters per tag, adjusted for links (characters and tags inside ``a``): text with few
tags and few links is dense. A node's sum is that of its children's densities; the node with the
largest sum holds the main text. The least density on the way from it up to ``body`` is the
threshold: what is as dense as that is content too. Everything is one pass over the page and
one back over its nodes, so time grows with the page alone.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import e, log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm.common import dealt_table, in_parts

#: Bytes of HTML that are turned into text before they are handed on.
PART_BYTES = 4 << 20
#: A list or block whose text is links by more than this share, three at least, is a menu.
MENU_SHARE, MENU_LINKS = 0.66, 3
#: An article within the core stands for it if it has this share of its text.
CORE_SHARE = 0.4

# Fixed values of HTML: what each kind of element means.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Their content is text up to their own end tag, whatever it looks like.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section select summary table tbody td tfoot th thead tr ul".split()
)
IN_HEAD = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Open elements that a start tag ends, up to the elements that bound the search.
_ITEM, _CELL = frozenset("ul ol menu dir dl".split()), frozenset(["table"])
_ROW, _PART = frozenset("td th".split()), frozenset("td th tr".split())
ENDS = {
    "li": (frozenset(["li"]), _ITEM), "dd": (frozenset("dd dt".split()), _ITEM), "dt": (frozenset("dd dt".split()), _ITEM), "td": (_ROW, _CELL | {"tr"}), "th": (_ROW, _CELL | {"tr"}),
    "tr": (_PART, _CELL), "tbody": (_PART | {"tbody", "thead", "tfoot"}, _CELL), "thead": (_PART | {"tbody", "thead", "tfoot"}, _CELL), "tfoot": (_PART | {"tbody", "thead", "tfoot"}, _CELL),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Elements that never hold an article's own text, and roles that say so of any element.
NOISE_TAGS = frozenset("aside button dialog embed footer form head menu nav object search select svg math canvas audio video map".split()) | RAW
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id names for menus, headers, footers, sidebars, notices, adverts, forms and comments.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising alert announcement banner breadcrumb breadcrumbs byads comment comments commentlist consent cookie cookies copyright "
    "disclaimer discussion disqus feedback foot footer footers form gdpr login menu menubar menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pager "
    "pagination paywall popup promo promos promoted promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors "
    "subscribe subscription taboola toolbar topbar trending widget widgets".split()
)
HEADER_WORDS = frozenset("header masthead".split())
#: A word of a name that turns the next one into a remark on the layout.
_ABOUT = frozenset("no has with without open free anti is".split())
ARTICLE_WORDS = frozenset("article post entry story".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style|aria-hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

KEPT, NOISE, HEADER, ARTICLE, MAIN = range(5)


@lru_cache(maxsize=4096)
def _kind(tag: str, attributes: str) -> int:
    """What an element says of itself by its tag, role, class and id."""
    if tag in NOISE_TAGS:
        return NOISE
    said, words = {"header": HEADER, "article": ARTICLE, "main": MAIN}.get(tag, KEPT), set()
    for name, *values in _NAMED.findall(attributes):
        name, value = name.lower(), _html.unescape("".join(values))
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _INVISIBLE.search(value)):
            return KEPT if tag in ("html", "body") else NOISE
        if name == "role":
            role = value.strip().lower()
            if role in NOISE_ROLES and tag not in ("html", "body"):
                return HEADER if role == "banner" else NOISE
            said = {"article": ARTICLE, "main": MAIN}.get(role, said)
        elif name == "itemprop" and value.lower() == "articlebody":
            said = ARTICLE
        elif name in ("class", "id"):
            for part in value.split():
                found = [w.lower() for w in _WORD.findall(part)]
                words |= {w for k, w in enumerate(found) if not (k and found[k - 1] in _ABOUT)}
    if tag not in ("html", "body", "main"):
        if words & NOISE_WORDS:
            return NOISE
        if words & HEADER_WORDS and said == KEPT and tag not in HEADINGS:
            return HEADER
        if words & ARTICLE_WORDS and said == KEPT and tag in ("div", "section", "td"):
            return ARTICLE
    return said


class Page:
    """The nodes of a page in page order; parents come before their children."""

    def __init__(self, text: str):
        self.tags, self.parents, self.kinds = ["#page"], [-1], [KEPT]
        #: (node, text) in page order; None for text starts a new block.
        self.pieces: list[tuple[int, str | None]] = []
        self._stack, self._inline = [0], [Counter()]
        self._open: Counter[str] = Counter()
        self._read(text)

    def _push(self, tag: str, attributes: str) -> None:
        parent = self._stack[-1]
        kind = NOISE if self.kinds[parent] == NOISE else _kind(tag, attributes)
        if kind == HEADER:  # a site's header; one inside an article is the article's own
            kind = KEPT if self._within else NOISE
        self.tags.append(tag)
        self.parents.append(parent)
        self.kinds.append(kind)
        if tag in BLOCK or tag == "br":
            self.pieces.append((parent, None))
        if tag in VOID:
            return
        self._stack.append(len(self.tags) - 1)
        self._open[tag] += 1
        self._within += kind in (ARTICLE, MAIN)
        if tag in BLOCK:
            self._inline.append(Counter())
        else:
            self._inline[-1][tag] += 1

    def _pop(self) -> str:
        node = self._stack.pop()
        tag = self.tags[node]
        self._open[tag] -= 1
        self._within -= self.kinds[node] in (ARTICLE, MAIN)
        if tag in BLOCK:
            self._inline.pop()
            self.pieces.append((self._stack[-1], None))
        else:
            self._inline[-1][tag] -= 1
        return tag

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self._open[tag]:
            return
        if self._open["head"] and tag not in IN_HEAD:
            self._close("head", frozenset())
        if tag in BLOCK and self._open["p"] and tag not in ("html", "body", "head"):
            self._close("p", BLOCK - {"p"})
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            while any(self._open[x] for x in ended) and self._close(ended, bounds):
                pass
        self._push(tag, attributes)

    def _close(self, tags, bounds: frozenset[str]) -> bool:
        """End the innermost open element of these tags, unless one of ``bounds`` lies in it.

        The search goes on block by block, so it is as short as the way down to the bound.
        """
        wanted = {tags} if isinstance(tags, str) else tags
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[k]]
            if tag in wanted:
                while len(self._stack) > k:
                    self._pop()
                return True
            if tag in bounds or len(self._stack) - k > 64:
                return False
        return False

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            if self._open[tag] and tag not in ("html", "body"):
                while self._pop() != tag:
                    pass
        elif self._inline[-1][tag]:  # inline elements end within their block only
            while self._pop() != tag:
                pass

    def _text(self, piece: str) -> None:
        if piece:
            self.pieces.append((self._stack[-1], _html.unescape(piece) if "&" in piece else piece))

    def _read(self, text: str) -> None:
        self._within = 0
        at, low = 0, None
        while (begin := text.find("<", at)) >= 0:
            following = text[begin + 1 : begin + 2]
            if following == "!" or following == "?":
                self._text(text[at:begin])
                mark = "-->" if text.startswith("<!--", begin) else "]]>" if text.startswith("<![CDATA[", begin) else ">"
                # the dashes that open a comment may be those that close it
                end = text.find(mark, begin + 2 if mark == "-->" else begin)
                at = len(text) if end < 0 else end + len(mark)
                continue
            m = None
            if following == "/" or following.isalpha():
                m = _TAG.match(text, begin) or _LOOSE.match(text, begin)
                if m is None and text.find(">", begin) < 0:  # the page ends within a tag
                    self._text(text[at:begin])
                    at = len(text)
                    break
            if m is None:  # a bare sign
                self._text(text[at : begin + 1])
                at = begin + 1
                continue
            self._text(text[at:begin])
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW and not m[3].endswith("/"):
                low = low or text.lower()
                end = low.find(f"</{tag}", at) if len(low) == len(text) else _find(text, f"</{tag}", at)
                at = len(text) if end < 0 else end
        self._text(text[at:])


def _find(text: str, what: str, at: int) -> int:
    m = re.compile(re.escape(what), re.IGNORECASE).search(text, at)
    return m.start() if m else -1


class Density(NamedTuple):
    """A value a node: characters, link characters, link tags, composite density, sum of the children's."""

    chars: list[int]
    linked: list[int]
    links: list[int]
    own: list[float]
    sums: list[float]


def densities(page: Page) -> Density:
    """Composite density of every node. Noise has none, and counts nowhere."""
    n = len(page.tags)
    chars, linked, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
    for node, piece in page.pieces:
        if piece and page.kinds[node] != NOISE:
            chars[node] += len(" ".join(piece.split()))
    for k in range(n - 1, 0, -1):
        if page.kinds[k] == NOISE:
            continue
        p = page.parents[k]
        if page.tags[k] == "a":
            linked[k] = chars[k]
            links[p] += 1
        chars[p] += chars[k]
        linked[p] += linked[k]
        tags[p] += tags[k] + 1
        links[p] += links[k]
    body = page.tags.index("body") if "body" in page.tags else 0
    share = linked[body] / max(1, chars[body])
    own = [0.0] * n
    for k in range(n):
        c, t = chars[k], max(1, tags[k])
        if c:
            base = log(c / max(1, c - linked[k]) * max(1, linked[k]) + share * c + e)
            own[k] = c / t * log(max(1.0, c / max(1, linked[k]) * t / max(1, links[k]))) / log(base)
    sums = [0.0] * n
    for k in range(n - 1, 0, -1):
        sums[page.parents[k]] += own[k]
    return Density(chars, linked, links, own, sums)


def _chosen(page: Page, found: Density) -> list[bool]:
    """Which nodes hold main text, with all that lies in them.

    The node of the largest sum below ``body`` is the core and the least density on its way up
    is the threshold. A node as dense as that marks the node of the largest sum in it. If the
    core lies in an article (or else in ``main``), or has one with CORE_SHARE of its text, that is chosen whole, however thin some of its
    parts are, and of the rest only articles beside it that reach the threshold. Headings right
    above what is chosen go with it.
    """
    n = len(page.tags)
    body = page.tags.index("body") if "body" in page.tags else 0
    inside = [False] * n
    inside[body] = True
    for k in range(body + 1, n):
        inside[k] = inside[page.parents[k]] and page.kinds[k] != NOISE
    best = list(range(n))  # the node of the largest sum in each subtree, the first of equals
    for k in range(n - 1, body, -1):
        if inside[k]:
            p, b = page.parents[k], best[k]
            if (found.sums[b], -b) > (found.sums[best[p]], -best[p]):
                best[p] = b
    core = best[body]
    way = [core]
    while way[-1] != body:
        way.append(page.parents[way[-1]])
    threshold = min(found.own[k] for k in way)
    marked = [False] * n
    for k in range(body, n):
        if inside[k] and found.chars[k] and found.own[k] >= threshold and best[k] != body:
            marked[best[k]] = True
        if inside[k] and found.chars[k] and page.parents[k] == body and core == body and found.own[k] >= threshold:
            marked[k] = True
    if core == body and not any(marked):
        marked[body] = True
    if core == body and 2 * sum(found.chars[k] for k in range(body + 1, n) if page.parents[k] == body and inside[k]) < found.chars[body]:
        marked[body] = True  # most text lies in body itself
    semantic = next((k for kind in (ARTICLE, MAIN) for k in way if page.kinds[k] == kind), None)
    if semantic is None:  # an article of few nodes lies in the core rather than around it
        under = [False] * n
        for k in range(core, n):
            under[k] = k == core or under[page.parents[k]]
        within = [k for k in range(core, n) if under[k] and inside[k] and page.kinds[k] in (ARTICLE, MAIN) and found.chars[k] >= CORE_SHARE * found.chars[core]]
        semantic = max(within, key=lambda k: (page.kinds[k] == ARTICLE, found.chars[k], -k), default=None)
    if semantic is not None:
        allowed = [False] * n
        for k in range(body, n):
            beside = page.kinds[k] == ARTICLE and page.parents[k] == page.parents[semantic]
            allowed[k] = k == semantic or beside or (k > body and allowed[page.parents[k]])
            marked[k] = k == semantic or (marked[k] and allowed[k])
    # the last block with text before each marked node, if that is a heading beside it
    last: dict[int, int] = {}
    for k in range(body + 1, n):
        if inside[k] and found.chars[k]:
            p = page.parents[k]
            if marked[k] and (h := last.get(p)) is not None and page.tags[h] in HEADINGS:
                marked[h] = True
            last[p] = k
    for k in range(body + 1, n):
        marked[k] = inside[k] and (marked[k] or marked[page.parents[k]]) and not _menu(page, found, k)
    return marked


def _menu(page: Page, found: Density, k: int) -> bool:
    return page.tags[k] in ("ul", "ol", "dl", "div", "section", "table") and found.links[k] >= MENU_LINKS and found.linked[k] > MENU_SHARE * found.chars[k]


def main_text(text: str | None) -> str:
    """The main text of a page: blocks in page order, one space between words and blocks."""
    if not text:
        return ""
    page = Page(text)
    marked = _chosen(page, densities(page))
    return " ".join("".join(" " if piece is None else piece for node, piece in page.pieces if marked[node] or piece is None).split())


def extract(pages: DataFrame) -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    Null and empty pages, and pages without main text, have an empty text. A page without
    markup is its own main text. Of nodes with equal sums the first is taken. Tags that are never
    closed end with what holds them; a comment, script or tag that is never closed lasts to the end of the
    page. White space is what Unicode calls so, no-break spaces included. Null ids and urls
    are kept, repeated rows give repeated results, extra columns are ignored, an empty table gives
    no rows. A task holds one page's nodes at a time, in proportion to the page's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in in_parts(batch, 2, PART_BYTES):
                texts = [main_text(x) for x in b.column(2).to_pylist()]
                arrays = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(dealt_table(spark, sf_dir, "pages"))
