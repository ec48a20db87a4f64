"""Main text of web pages: parser events, text-to-tag ratio by line, Gaussian smoothing, threshold clustering.

A page streams through the standard library's parser once. Block-level tags end a line; each line keeps its text, the
number of tags met in it and the container it stands in. Tags and names only exclude what is no article by kind (menus,
forms, notices, adverts, comments, ...). The other lines' text-to-tag ratios are smoothed, and those of at least one
standard deviation are the content cluster. Containers that hold much of the cluster's text are the content regions, or
the articles around them; what lies between regions of one container belongs to them. In a region short lines stay too,
but beyond an article neither blocks of links nor blocks apart from the cluster. All steps are linear in the page.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import portions

#: Standard deviation, in lines, of the smoothing.
SIGMA = 1.0
#: A container, or an article, is a region if it has at least this share of the text in the cluster that the best one has.
REGION_SHARE, ARTICLE_SHARE = 0.2, 0.5
#: A line with at least this share of its characters in links is none of a region without an article.
LINK_SHARE = 0.7
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Blocks that hold lines rather than other blocks: the container of their lines is further up.
_LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre td th tr tbody thead tfoot table caption ul ol dl dt dd figure figcaption address details summary".split())
_OUT = frozenset("nav footer aside form script style noscript template svg iframe object canvas button select option textarea input label fieldset dialog menu audio video head title".split())
_HEAD = frozenset("head title meta link style script base noscript template".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words that mark boilerplate in a class or id, and words that stand beside them without saying anything.
_OUT_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adbox adsense banner banners breadcrumb breadcrumbs comment comments
    commentlist disqus consent cookie cookies gdpr footer header masthead login signup register menu menus modal nav navbar navigation
    newsletter subscribe subscription notice notices notification overlay pager pagination popup promo promos promotion promoted recommended
    recommendations related replies reply search share sharing sidebar social sponsor sponsored sponsors toolbar widget widgets hidden
    responses feedback""".split()
)
_NEUTRAL = frozenset(
    """area article articles bar block body bottom box boxes btn button buttons col column container content css data desktop div field form
    global group holder icon icons id inner item items js left link links list main message mobile module new outer page pages panel post posts primary
    reader readers right row secondary section site slot small sticky sub tag text thread title toggle top ui unit user users view wrap wrapper""".split()
)
#: An open element that a start tag ends, as far as no other block but a paragraph lies between.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "tbody", "thead"}, "tfoot": {"td", "th", "tr", "tbody"}}
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_REGIONS = frozenset(["article", "main"])


def _names_boilerplate(value: str, inside: bool) -> bool:
    """Whether a class or id has a name made of boilerplate words and neutral ones only: not ``related-work``."""
    for name in value.split():
        words = [w for w in _SPLIT.split(_CAMEL.sub(" ", name).lower()) if w and not w.isdigit()]
        marks = [w for w in words if w in _OUT_WORDS and not (inside and w == "header")]
        if marks and all(w in _OUT_WORDS or w in _NEUTRAL for w in words):
            return True
    return False


class _Lines(HTMLParser):
    """Lines and blocks of a page. Block 0 is the page; a block's number is above its parent's."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, boilerplate inside, block
        self.blocks: list[tuple[int, dict[str, int]]] = []  # of open blocks: place in the stack, open inline tags within
        self.loose: dict[str, int] = {}  # open inline tags outside all blocks
        self.open = {"a": 0, "article": 0, "main": 0, "head": 0}
        self.count: dict[str, int] = {}  # open elements by tag
        self.parent, self.kind = [0], [""]
        self.lines: list[tuple[int, str, int, int]] = []  # block, text, tags, characters in links
        self.text: list[str] = []
        self.tags = self.linked = self.at = 0

    def _end_line(self) -> None:
        if self.text and (text := " ".join("".join(self.text).split())):
            self.lines.append((self.at, text, self.tags, self.linked))
            self.tags = 0
        self.text, self.linked = [], 0

    def _boilerplate(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("html", "body", "main"):
            return False
        if tag in _OUT:
            return True
        inside = bool(self.open["article"] or self.open["main"])
        if tag == "header":
            return not inside
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id"):
                if _names_boilerplate(value, inside):
                    return True
            elif name == "role" and value.strip().lower() in _OUT_ROLES:
                return True
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return True
            elif name == "style" and _HIDDEN.search(value):
                return True
        return False

    def _inline(self) -> dict[str, int]:
        return self.blocks[-1][1] if self.blocks else self.loose

    def _close(self, place: int) -> None:
        """Closes all open elements from a place of the stack on."""
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.count[tag] -= 1
            if tag in self.open:
                self.open[tag] -= 1
            if tag in _INLINE:
                self._inline()[tag] -= 1
            else:
                self.blocks.pop()
        self.at = self.stack[-1][2] if self.stack else 0

    def _imply_ends(self, tag: str) -> None:
        if self.open["head"] and tag not in _HEAD:
            self.handle_endtag("head")
        if tag in _INLINE:
            return
        ends = _ENDS.get(tag, ())
        while self.blocks:
            place = self.blocks[-1][0]
            if self.stack[place][0] != "p" and self.stack[place][0] not in ends:
                break
            self._close(place)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _INLINE:
            self._end_line()
            self._imply_ends(tag)
        elif self.open["head"]:
            self._imply_ends(tag)
        outside = bool(self.stack and self.stack[-1][1])
        self.tags += not outside
        if tag in _VOID:
            return
        out, block = outside or self._boilerplate(tag, attrs), self.at
        if tag in _INLINE:
            inline = self._inline()
            inline[tag] = inline.get(tag, 0) + 1
        else:
            block = len(self.parent)
            self.parent.append(self.at)
            self.kind.append(tag)
            self.blocks.append((len(self.stack), {}))
        self.stack.append((tag, out, block))
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in self.open:
            self.open[tag] += 1
        self.at = block

    def handle_endtag(self, tag: str) -> None:
        self.tags += not (self.stack and self.stack[-1][1])
        if tag not in _INLINE:
            self._end_line()
        # an inline end tag doesn't reach beyond its block
        if not (self._inline().get(tag) if tag in _INLINE else self.count.get(tag)):
            return
        place = len(self.stack) - 1
        while self.stack[place][0] != tag:
            place -= 1
        self._close(place)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][1]:
            return
        self.text.append(data)
        if self.open["a"]:
            self.linked += len(data)


def smooth(x: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing; at the ends by the weights that there are."""
    radius = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-((k / sigma) ** 2) / 2) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(x)):
        total = weight = 0.0
        for k, w in enumerate(kernel, i - radius):
            if 0 <= k < len(x):
                total += w * x[k]
                weight += w
        out.append(total / weight)
    return out


def content_cluster(lines: list[tuple[int, str, int, int]]) -> list[bool]:
    """Which lines have a smoothed text-to-tag ratio of at least one standard deviation of them all; all, if they are alike."""
    ratio = smooth([len(text) / max(1, tags) for _, text, tags, _ in lines], SIGMA)
    mean = sum(ratio) / len(ratio)
    threshold = math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio))
    return [r >= threshold for r in ratio]


def _kept(lines: list[tuple[int, str, int, int]], cluster: list[bool], parent: list[int], kind: list[str]) -> Iterator[str]:
    """Texts of the lines in the regions that the cluster picks."""
    n = len(parent)
    holder, article = [0] * n, [0] * n  # of each block: the container that it or its lines belong to, the outermost article around
    for b in range(1, n):
        holder[b] = holder[parent[b]] if kind[b] in _LEAVES else b
        article[b] = article[parent[b]] or (b if kind[b] == "article" else 0)
    main = [0] * n
    for b in range(1, n):
        main[b] = main[parent[b]] or (b if kind[b] == "main" else 0)
    sizes: dict[int, int] = {}
    for (b, text, _, _), inside in zip(lines, cluster):
        if inside:
            top = article[b] or main[b] or holder[b]
            sizes[top] = sizes.get(top, 0) + len(text)
    marked = {b for b in sizes if kind[b] == "article"} or {b for b in sizes if kind[b] == "main"}
    if marked:
        best = max(sizes[b] for b in marked)
        chosen = {b for b in marked if sizes[b] >= ARTICLE_SHARE * best}
        root = -1
    else:
        best = max(sizes.values())
        chosen = {b for b, size in sizes.items() if size >= REGION_SHARE * best}
        under = [int(b in chosen) for b in range(n)]  # chosen containers in each block
        for b in range(n - 1, 0, -1):
            under[parent[b]] += under[b]
        root = max(b for b in range(n) if under[b] == len(chosen) and (b == 0 or kind[b] not in _LEAVES))
    inside = [b in chosen for b in range(n)]
    for b in range(1, n):
        inside[b] = inside[b] or inside[parent[b]]
    if marked:
        yield from (text for b, text, _, _ in lines if inside[b])
        return
    below = [b == root for b in range(n)]
    for b in range(root + 1, n):
        below[b] = below[b] or below[parent[b]]
    hits = [0] * n  # cluster lines in each container
    for (b, *_), hit in zip(lines, cluster):
        hits[holder[b]] += hit
    for b in range(n - 1, 0, -1):
        hits[parent[b]] += hits[b]
    at = [i for i, (b, *_) in enumerate(lines) if cluster[i] and inside[b]]
    for i, (b, text, _, linked) in enumerate(lines):
        if not below[b] or linked >= LINK_SHARE * len(text):
            continue
        own = holder[b]
        if own == root or inside[b] and hits[own] or at[0] <= i <= at[-1] or inside[b] and kind[own] not in ("", "html", "body"):
            yield text


def main_text(html: str) -> str:
    """The blocks of the page's content regions, joined by one space; empty if there is no text outside boilerplate."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    if not parser.lines:
        return ""
    return " ".join(_kept(parser.lines, content_cluster(parser.lines), parser.parent, parser.kind))


def extract_main_text(pages: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``carry`` columns and ``text`` for each row of ``pages``.

    A null or empty page, or one without text outside boilerplate, gives ''. Repeated rows give a row each. Very long and
    deeply nested pages take time in proportion to their length. Columns
    other than ``carry`` are dropped, so that one named ``text`` doesn't clash.
    """
    picked = pages.select(*carry, F.col(html_col).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in portions(batch.column("__html")):
                part = batch.slice(begin, end - begin)
                texts = [main_text(h or "") for h in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*carry, "text"])

    fields = [picked.schema[c] for c in carry]
    return picked.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
