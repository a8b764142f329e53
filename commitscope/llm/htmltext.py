"""Main text of HTML pages by maximum-scoring subsequence.

A page becomes a sequence of tokens in page order.  Words outside menus,
headers, footers, sidebars, notices, adverts, forms and reader comments score
positive, other words and all tags negative; one linear scan finds the run of
tokens with the largest sum, and the words in it that scored positive are the
article, block by block.  Inside an element that marks the article nothing
scores negative, so long figures or asides in it cut no block off.

Weights come from labelled pages: pages that mark their article with an
``article`` or ``main`` element tell which tags stand inside and outside of
main text.  ``learn_weights`` counts them over a bounded sample; ``PRIOR``
holds for whatever the sample doesn't show.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import quoted

MAX_TRAIN_PAGES = 2_000

# Fixed values of HTML and of common page templates.
SILENT = frozenset("script style head title template noscript iframe object svg math canvas audio video map textarea "
                   "select datalist noembed noframes".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p "
                   "pre search section summary table tbody tfoot thead tr ul".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong "
                   "sub sup td th time tt u var br wbr img".split())
ARTICLE = frozenset(["article", "main"])
ASIDE = frozenset("nav footer aside form menu search dialog button fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar "
                        "toolbar status".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo "
                        "promotion promoted comment comments commentlist disqus reply replies respond share sharing "
                        "social related recommended recommendations newsletter subscribe subscription signup cookie "
                        "cookies consent gdpr notice notices alert popup modal overlay breadcrumb breadcrumbs "
                        "pagination pager toolbar login copyright disclaimer form".split())
LAYOUT_WORDS = frozenset("nav navbar navigation menu header masthead footer sidebar side aside banner widget widgets "
                         "topbar search".split())
# Comments alone are often longer than what they are about.
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond list section thread threads area "
                          "wrapper body content text item".split())
CONTENT_WORDS = frozenset("article entry post content main story body text".split())
# What opens closes these still open ones of its own kind.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
          "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
          "option": ("option", ("select",))}

# What class and id say of an element: a part of a layout, a name that asides
# have, nothing but reader comments.
LAYOUT, NAMED, COMMENTS = 1, 2, 3
WORD, WORD_ASIDE, WORD_OUTSIDE, TAG = "word", "aside", "outside", "tag"
PRIOR = {WORD: 1.0, WORD_ASIDE: -0.25, WORD_OUTSIDE: -1.0, TAG: -0.05}
KNOWN = frozenset(SILENT | RAW | VOID | BLOCKS | INLINE | ASIDE)

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)",
    re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _class_mark(value: str) -> int:
    """What a class or id says.  A token of content words only outvotes the
    names of asides beside it (``post comments-open``)."""
    mark, content = 0, False
    for one in unescape(value).split():
        words = {w.lower() for w in _PART.findall(one)}
        if words & ASIDE_WORDS:
            mark = max(mark, COMMENTS if words <= COMMENT_WORDS else NAMED)
        elif words & LAYOUT_WORDS and not words & CONTENT_WORDS:
            mark = max(mark, LAYOUT)
        elif words & CONTENT_WORDS:
            content = content or not words & LAYOUT_WORDS
    return 0 if content and mark >= NAMED else mark


def _marked(attributes: str) -> tuple[bool, int]:
    """Whether an element's attributes say for certain that it isn't main
    text, and the mark of its names."""
    sure, mark = False, 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            sure = True
        elif name == "role":
            sure = sure or value.strip().lower() in ASIDE_ROLES
        elif name == "style":
            sure = sure or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        elif name in ("class", "id"):
            mark = max(mark, _class_mark(value))
    return sure, mark


class _Element:
    """``words`` are those of its own, later of all within it; ``index`` and
    ``end`` bound its descendants in page order."""

    __slots__ = ("tag", "up", "sure", "mark", "out", "article", "scope", "words", "index", "end")

    def __init__(self, tag: str, up: "_Element | None", index: int, sure: bool = False, mark: int = 0):
        self.tag, self.up, self.sure, self.mark = tag, up, sure, mark
        self.index = self.end = index
        self.words, self.out, self.article, self.scope = 0, False, False, self


def _articles(elements: list["_Element"]) -> set["_Element"]:
    """The outermost ``article`` and ``main`` elements that hold main text.

    Those free of asides do.  Of those held by one (a class of their own, a
    wrapper, an element left open), the longest does if no free one has as
    many words, and with it those of the same holder: a teaser in a sidebar is
    none, a page in a wrapper named like an aside is.  Those of reader
    comments never do.
    """
    levels: list[int] = []
    holders: list[_Element | None] = []
    roots: list[_Element | None] = []
    silent: list[bool] = []
    words: dict[_Element, int] = {}
    for e in elements:
        up = e.up.index if e.up is not None else None
        own = 2 if e.mark == COMMENTS else 1 if e.sure or e.mark else 0
        levels.append(max(own, levels[up] if up is not None else 0))
        holders.append(e if own else holders[up] if up is not None else None)
        root = roots[up] if up is not None else None
        silent.append(root is not None and (e.sure or silent[up]))
        if root is None and e.tag in ARTICLE:
            root = e
            words[e] = 0
        roots.append(root)
        if root is not None and not silent[-1]:
            words[root] += e.words
    chosen = {e for e in words if levels[e.index] == 0}
    held = [e for e in words if levels[e.index] == 1]
    longest = max(held, key=words.__getitem__, default=None)
    if longest is not None and words[longest] > max((words[e] for e in chosen), default=-1):
        chosen.update(e for e in held if holders[e.index] is holders[longest.index])
    return chosen


def _settle(elements: list["_Element"]) -> bool:
    """Decides what is article and what aside (``out``, inherited down to the
    next article); whether the page marks an article.

    Of elements with marks, none that holds most of the words (of its
    article, if it stands in one, else of the page) is an aside; of comments,
    none with less than a tenth of the words beside it.  Comments first, then
    small ones first; words of asides no longer count for what holds them.
    """
    articles = _articles(elements)
    top = elements[0]
    named: list[_Element] = []
    for e in elements[1:]:
        fresh = e in articles
        e.article = fresh or e.up.article
        e.scope = e if fresh else e.up.scope
        if fresh:  # marks of its own and above don't reach into it
            e.sure, e.mark = False, 0
        else:
            e.sure = e.sure or e.up.sure
            if e.tag == "header" and not e.article:
                e.mark = max(e.mark, LAYOUT)
        if e.sure:
            e.words = 0
        elif e.mark:
            named.append(e)
    for e in reversed(elements[1:]):
        e.up.words += e.words
        e.up.end = max(e.up.end, e.end)

    # Words of asides found so far, summed over ranges of the marked elements.
    index = [e.index for e in named]
    sums = [0] * (len(named) + 1)

    def upto(i: int) -> int:
        total = 0
        while i:
            total += sums[i]
            i &= i - 1
        return total

    def left(e: _Element) -> int:
        return e.words - upto(bisect_right(index, e.end)) + upto(bisect_left(index, e.index))

    for mark in (COMMENTS, NAMED, LAYOUT):
        todo, within = [], None
        for i, e in enumerate(named):
            if within is not None and e.index <= within.end and e.scope is within.scope:
                continue
            if e.out:
                within = e
            elif e.mark == mark:
                todo.append((e.words, -i))
        for _, i in sorted(todo):
            e = named[-i]
            words, whole = left(e), left(e.scope if e.mark != LAYOUT and e.article else top)
            e.out = 10 * words <= 9 * whole if mark == COMMENTS else 2 * words <= whole
            if e.out and mark != LAYOUT:
                i = 1 - i
                while i < len(sums):
                    sums[i] += words
                    i += i & -i
    for e in elements[1:]:
        e.out = e.sure or e.out or (e.up.out and e.scope is e.up.scope)
    return bool(articles)


Token = tuple[str, object, "_Element"]


def tokens(html: str) -> tuple[list[Token], bool]:
    """``("word", text run, element)``, ``("tag", name, element)``, and
    whether the page marks an article.  Linear in the page, however deep it
    nests: open elements are found by tag, not by walks to the root."""
    out: list[Token] = []
    top = _Element("", None, 0)
    elements, stack = [top], [top]
    depths: dict[str, list[int]] = {}  # tag -> depths at which it is open
    pos, n = 0, len(html)

    def text(run: str) -> None:
        run = unescape(run) if "&" in run else run
        if run and stack[-1].tag not in SILENT:
            out.append((WORD, run, stack[-1]))
            stack[-1].words += len(run.split())

    def deepest(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    def close(names, until=()) -> None:
        depth = deepest(names)
        if depth > deepest(until):
            for e in stack[depth:]:
                depths[e.tag].pop()
            del stack[depth:]

    scan = _TOKEN.finditer(html)
    while (m := next(scan, None)) is not None:
        if m.start() > pos:
            text(html[pos:m.start()])
        pos = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            out.append((TAG, "/" + tag, stack[-1]))
            close((tag,), ("table",) if tag in ("td", "th", "tr") else ())
            continue
        if tag in BLOCKS:
            close(("p",), ("button", "td", "th", "div", "li", "article", "section", "aside", "blockquote"))
        if tag in CLOSES:
            names, until = CLOSES[tag]
            for name in names.split()[::-1]:
                close((name,), until)
        if tag in VOID:
            out.append((TAG, tag, stack[-1]))
            continue
        sure, mark = (False, 0) if tag in ("html", "body") else _marked(m.group(3))
        e = _Element(tag, stack[-1], len(elements), sure or tag in ASIDE or tag in SILENT, mark)
        elements.append(e)
        out.append((TAG, tag, e))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, pos)
            pos = end.end() if end else n
            # Nothing within it begins a token.
            scan = _TOKEN.finditer(html, pos)
        else:
            depths.setdefault(tag, []).append(len(stack))
            stack.append(e)
    if pos < n:
        text(html[pos:])
    return out, _settle(elements)


def best_run(scores: list[float]) -> tuple[int, int]:
    """``[start, end)`` of the contiguous run with the largest sum, the
    longest of equal ones that begin first; empty if no sum is positive."""
    best, found = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def extract(html: str | None, weights: dict[str, float] | None = None) -> str:
    """The main text: blocks joined by two line feeds, white space within a
    block as one space.  Null, empty and text-free pages give ''."""
    weights = weights or {}
    sequence, marked = tokens(html or "")
    kinds, scores = [], []
    for kind, value, element in sequence:
        if kind == TAG:
            kinds.append(TAG)
            # An article that is marked as such is whole, whatever stands in it.
            scores.append(0.0 if element.article else weights.get(value.lstrip("/"), PRIOR[TAG]))
            continue
        kind = WORD_ASIDE if element.out else WORD_OUTSIDE if marked and not element.article else WORD
        kinds.append(kind)
        scores.append(0.0 if kind == WORD_ASIDE and element.article else PRIOR[kind] * len(value.split()))
    start, end = best_run(scores)
    blocks, run = [], []
    for kind, (_, value, element) in zip(kinds[start:end], sequence[start:end]):
        if kind == WORD:
            run.append(value)
        elif kind == TAG:
            name = value.lstrip("/")
            if name in BLOCKS:
                blocks.append(run)
                run = []
            elif name in ("br", "td", "th"):
                run.append(" ")
    blocks.append(run)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)


def tag_counts(html: str | None) -> Counter:
    """``(tag, inside)`` counts of a page that marks its article, else none."""
    sequence, marked = tokens(html or "")
    if not marked:
        return Counter()
    return Counter((value if value in KNOWN else "other", element.article)
                   for kind, value, element in sequence if kind == TAG and not value.startswith("/"))


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                  max_pages: int = MAX_TRAIN_PAGES) -> dict[str, float]:
    """A negative weight per tag, the larger the more it stands outside of
    articles, from at most ``max_pages`` pages (smallest hash of id)."""
    ship_package(pages.sparkSession)
    sample = (pages.select(F.xxhash64(quoted(id_col)).alias("k"), quoted(html_col).cast("string").alias("html"))
              .filter("instr(lower(html), '<article') > 0 or instr(lower(html), '<main') > 0"))
    limit = sample.select("k").distinct().orderBy("k").limit(max_pages).agg(F.max("k")).first()[0]
    if limit is None:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = sum((tag_counts(h.as_py()) for h in batch.column("html")), Counter())
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in counts], pa.string()), pa.array([i for _, i in counts], pa.bool_()),
                 pa.array(list(counts.values()), pa.int64())], names=["tag", "inside", "n"])

    # A row per known tag and side reaches the driver.
    rows = (sample.filter(F.col("k") <= limit).select("html").mapInArrow(run, "tag string, inside boolean, n long")
            .groupBy("tag", "inside").agg(F.sum("n").alias("n")).collect())
    inside = {r["tag"]: r["n"] for r in rows if r["inside"]}
    outside = {r["tag"]: r["n"] for r in rows if not r["inside"]}
    a, b = sum(inside.values()) + 1, sum(outside.values()) + 1
    odds = {t: math.log((outside.get(t, 0) + 1) / b) - math.log((inside.get(t, 0) + 1) / a) for t in {*inside, *outside}}
    return {t: PRIOR[TAG] - 0.25 * min(4.0, max(0.0, o)) for t, o in sorted(odds.items())}


def main_text(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id",
              url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars`` (code points).

    Null html counts as empty; pages without main text give an empty text;
    an empty table gives no rows; other columns are ignored.
    """
    ship_package(pages.sparkSession)
    source = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).alias("url"),
                          quoted(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), weights).encode("utf-8", "replace").decode() for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    id_type, url_type = (source.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return source.mapInArrow(run, f"page_id {id_type}, url {url_type}, text string, n_chars long")
