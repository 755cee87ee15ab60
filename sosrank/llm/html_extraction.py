"""Main text of HTML pages by the maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score positive, tags and words of page furniture negative, with
weights learned from labelled pages: those that mark their article themselves (an ``article`` or ``main`` element).
One linear scan finds the contiguous region with the highest sum, and the words of that region which are not in
furniture are the text. Furniture is what an element's name, role, class or id says: menus, headers outside the
article, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments. Inside an article element
furniture scores nothing, so that it is left out without cutting the article in two.

Weights are fitted on the labelled ones of about FIT_PAGES pages, chosen by a hash of their text; extraction reads every
page whole.

Results in odd cases: null or empty html, and pages without words, give an empty text; an element without an end tag
ends where HTML ends it: with its parent, or at a start tag that implies its end (a block after <p>, <li> after <li>);
furniture that is still open ends where the article starts or ends, or with the page; of regions that score alike the first is taken; rows repeated with one
id are extracted alike; without labelled pages DEFAULT_WEIGHTS hold; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sosrank.llm.common import ship

#: Pages that the weights are fitted on, at most (in expectation).
FIT_PAGES = 2_000
#: What a word, a word in a link, a word in furniture and a tag score where nothing is learned.
DEFAULT_WEIGHTS = {"word": 1.0, "link": -1.0, "furniture": -3.0, "tag": -1.5}
#: A tag inside an article element: markup does not cut the article that the page itself delimits.
IN_ARTICLE = -0.05
#: Bounds of learned weights: words of text score positive, tags negative.
WORD_BOUNDS, TAG_BOUNDS, FURNITURE_BOUNDS = (0.25, 2.0), (-8.0, -0.25), (-4.0, -0.5)

_ATTRS = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # drawings and formulas may close themselves; what else holds no text of the page ends with its own end tag, and
    # where that is missing only elements whose content is raw text take the rest of the page
    rf"|<(?:svg|math)(?=[\s/>]){_ATTRS}(?<=/)>"
    rf"|<(?P<raw>script|style|noscript|textarea|title|iframe)(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<void>template|svg|math|object|canvas|select)(?=[\s/>]){_ATTRS}>.*?</(?P=void)\s*>"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>{_ATTRS})>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Element names and words of class, id and role that mark furniture.
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog button fieldset label input".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion"
    " banner banners cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups"
    " modal overlay newsletter subscribe subscription signup paywall comment comments commentlist disqus replies reply"
    " sidebar sidebars widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs"
    " menu menus nav navbar navigation pager pagination footer masthead topbar toolbar login search searchform form"
    " complementary contentinfo dialog skiplink copyright".split())
ARTICLE_TAGS = frozenset(("article", "main"))
#: Elements that hold the text of an article itself.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption".split())
#: Elements that stand in a line of text; all others end the block before and after them. <br> is white space.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements that an end tag or an implied end does not reach out of, by HTML's rules; the second for p, the third and
#: fourth for the end and the start of items of lists.
_SCOPE = ("table", "td", "th", "caption", "marquee", "applet")
_P_SCOPE, _LI_SCOPE = (*_SCOPE, "button"), (*_SCOPE, "ol", "ul")
_ITEM_SCOPE = (*_SCOPE, *("ol ul menu dir dl section article main aside nav header footer blockquote figure form"
                          " fieldset details button center").split())
_CELLS, _ROW, _GROUPS = ("td", "th", "caption"), ("tr",), ("tbody", "thead", "tfoot", "colgroup")
#: Start tag: the open elements whose end it implies, with what they must not stand outside of.
IMPLIED: dict[str, list[tuple[tuple[str, ...], tuple[str, ...]]]] = {
    name: [(("p",), _P_SCOPE)] for name in (
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form"
        " h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p plaintext pre search section summary table ul"
        " xmp").split()}
IMPLIED |= {"li": [(("li",), _ITEM_SCOPE), (("p",), _P_SCOPE)], "a": [(("a",), _SCOPE)],
            "button": [(("button",), _SCOPE)]}
IMPLIED |= dict.fromkeys(("dd", "dt"), [(("dd", "dt"), _ITEM_SCOPE), (("p",), _P_SCOPE)])
IMPLIED |= dict.fromkeys(("td", "th"), [(_CELLS, ("table",))])
IMPLIED |= {"tr": [(_CELLS, ("table",)), (_ROW, ("table",))]}
IMPLIED |= dict.fromkeys(_GROUPS, [(_CELLS, ("table",)), (_ROW, ("table",)), (_GROUPS, ("table",))])
#: End tags that reach further or less far than _SCOPE.
_END_SCOPE = {"p": _P_SCOPE, "li": _LI_SCOPE, "table": ()} | dict.fromkeys((*_CELLS, *_ROW, *_GROUPS), ("table",))


def _is_furniture(name: str, attrs: str, in_article: bool) -> bool:
    if name in FURNITURE_TAGS or name == "header" and not in_article:
        return True
    if not attrs or name in ARTICLE_TAGS or name in ("body", "html"):
        return name in ARTICLE_TAGS and _says_furniture(attrs)
    return _says_furniture(attrs, strict=in_article and name in TEXT_BLOCKS)


def _says_furniture(attrs: str, strict: bool = False) -> bool:
    """Whether the attributes mark furniture; ``strict``: by whole names of classes only, as a paragraph of an article
    may be of any class (``notice-period``) and its headings have ids to be linked to."""
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if strict and key == "id":
            continue
        if key in ("class", "id", "role"):
            words = set(value.lower().split()) if strict else {w.lower() for w in _PARTS.findall(value)}
            if words & FURNITURE_WORDS or {"site", "page"} & words and "header" in words:
                return True
        elif key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


class _Open:
    """The elements that are open at a place of a page; a step takes time by what it closes, not by how many are open."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def _last(self, names: tuple[str, ...]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def _cut(self, size: int) -> None:
        while len(self.names) > size:
            self.at[self.names.pop()].pop()
        while self.blocks and self.blocks[-1] >= size:
            self.blocks.pop()

    def imply(self, name: str) -> None:
        """End what the start tag ``name`` ends."""
        for ended, scope in IMPLIED.get(name, ()):
            i = self._last(ended)
            if i > self._last(scope):
                self._cut(i)

    def start(self, name: str) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.names.append(name)

    def end(self, name: str) -> bool:
        """End the last open ``name`` with all inside, if its end tag reaches it from here; say whether."""
        i = self._last((name,))
        if i < 0 or (self.blocks and self.blocks[-1] > i if name in INLINE
                     else i < self._last(_END_SCOPE.get(name, _SCOPE))):
            return False
        self._cut(i)
        return True


def events(html: str) -> Iterator[tuple[str, str, bool, bool]]:
    """The page in order: ``(kind, what, in furniture, in article)``.

    ``kind`` is ``tag`` (``what``: its name, with a slash if it ends), ``word`` or ``link`` (``what``: a run of text).
    """
    at, article, links, zone, base, opened = 0, 0, 0, "", 0, _Open()
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            yield "link" if links else "word", html[at:m.start()], bool(zone), article > 0
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name, ends = name.lower(), bool(m["end"])
        closed = ends or m["attrs"].endswith("/") or name in VOID
        if ends:
            reached = opened.end(name)
        else:
            opened.imply(name)
        own = False
        if zone and len(opened.names) <= base:
            own = ends and len(opened.names) == base  # otherwise its parent's end, or a start tag that implies its own
            zone = ""
        elif zone and name in ARTICLE_TAGS and ends and article and not reached:
            zone = ""  # the article's end, where the nesting is broken
        if zone and not ends and (name in ARTICLE_TAGS and not _says_furniture(m["attrs"])
                                  or name == "h1" and not article) and zone not in ("header", "form"):
            zone = ""  # furniture that was never closed ends where the article starts
        furniture = not (zone or ends) and _is_furniture(name, m["attrs"], article > 0)
        if not (ends or closed):
            if furniture:
                zone, base = name, len(opened.names)
            opened.start(name)
        if zone or own or furniture:
            pass
        elif name in ARTICLE_TAGS:
            article = max(0, article + (-1 if ends else 1))
        elif name == "a":
            links = 0 if closed else 1
        yield "tag", f"/{name}" if ends else name, bool(zone), article > 0
    if at < len(html):
        yield "link" if links else "word", html[at:], bool(zone), article > 0


def count_labelled(html: str) -> Counter[tuple[str, bool]]:
    """(class, in the article) -> how often, for a page with an article element; nothing for others."""
    counts: Counter[tuple[str, bool]] = Counter()
    found = False
    for kind, what, furniture, article in events(html):
        found |= article
        if kind == "tag":
            counts[what, article and not furniture] += 1
        else:
            n = len(what.split())
            counts["furniture" if furniture else kind, article and not furniture] += n
    return counts if found else Counter()


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of standing in the article, against all words' odds, within the bounds of the class."""
    weights = dict(DEFAULT_WEIGHTS)
    for name in {k for k, _ in counts}:
        odds = math.log((counts.get((name, True), 0) + 1) / (counts.get((name, False), 0) + 1))
        low, high = {"word": WORD_BOUNDS, "link": (-4.0, 1.0), "furniture": FURNITURE_BOUNDS}.get(name, TAG_BOUNDS)
        weights[name] = min(max(odds, low), high)
    return weights


def extract(html: str | None, weights: dict[str, float]) -> str:
    """The main text: its blocks, one a line."""
    if not html:
        return ""
    seq = list(events(html))
    best, best_span, run, start = 0.0, (0, 0), 0.0, 0
    tag, word = weights["tag"], weights["word"]
    for i, (kind, what, furniture, article) in enumerate(seq):
        if kind == "tag":
            score = (0.0 if furniture else IN_ARTICLE) if article else weights.get(what, tag)
        elif furniture:
            score = 0.0 if article else weights["furniture"] * len(what.split())
        else:
            score = (word if article else weights[kind]) * len(what.split())
        if run <= 0.0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, best_span = run, (start, i + 1)
    blocks, line = [], []
    for kind, what, furniture, _ in seq[best_span[0]:best_span[1]]:
        if kind == "tag":
            if what.lstrip("/") not in INLINE:
                blocks.append("".join(line))
                line = []
            elif what == "br":
                line.append(" ")
        elif not furniture:
            line.append(unescape(what))
    blocks.append("".join(line))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def learn_weights(pages: DataFrame, html_col: str = "html", fit_pages: int = FIT_PAGES) -> dict[str, float]:
    """Weights from the labelled ones of ``fit_pages`` pages; the counts are summed by Spark, a row a class."""
    ship(pages.sparkSession)
    share = max(1, (1 << 40) * fit_pages // max(1, pages.count()))
    sample = (pages.select(F.col(html_col).alias("html"))
              .filter(F.col("html").isNotNull())
              .filter(F.pmod(F.xxhash64(F.lit("fit"), "html"), F.lit(1 << 40)) < share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[tuple[str, bool]] = Counter()
            for page in batch.column(0):
                total.update(count_labelled(page.as_py()))
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.string()), pa.array([b for _, b in keys], pa.bool_()),
                 pa.array([total[k] for k in keys], pa.int64())], ["name", "inside", "n"])

    counts = sample.mapInArrow(run, "name string, inside boolean, n long").groupBy("name", "inside").agg(
        F.sum("n").alias("n")).collect()
    return weights_from({(r.name, r.inside): r.n for r in counts})


def extract_pages(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id",
                  url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    weights = weights or learn_weights(pages, html_col)
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.drop("html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], out.names)

    return rows.mapInArrow(run, out)
