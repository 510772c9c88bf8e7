"""Main text of web pages: flat text blocks judged by a decision tree.

A page is read once, in linear time, into the text blocks between block-level tags.  What is no text
of the page (scripts, styles, comments) and what its markup names as surroundings (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments) is marked.  A block is described by its
words and link density, those of its neighbours, and the kind of its containers.  A decision tree,
grown from a small labelled table of page layouts, keeps the blocks of the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import text_batches

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: The rest of a tag; quotes hide its end only after an equals sign, as browsers read it.
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_HINT = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary"
    " table tbody td tfoot th thead title tr ul".split()
)
#: Characters that make a "<" before them the start of a tag.
_OPENERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ/!?")
#: Elements without text of the page; of the first ones an open one ends with the page.
_RAW_TEXT = frozenset("script style textarea title iframe".split())
_RAW = frozenset("noscript template object svg math canvas audio video select".split()) | _RAW_TEXT
_CONTENT = frozenset("article main".split())
_FRAME = frozenset("aside button dialog dir footer form head header menu nav".split())
#: Their attributes say how the page is laid out, not what it is.
_WHOLE = frozenset("html body".split())
_HOLDERS = frozenset("div section ul ol table td details fieldset span p figure blockquote li dl".split()) | _CONTENT | _FRAME
#: Parts of class, id and role names that mark what surrounds an article.
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice"
    " notices alert popup modal overlay newsletter subscribe subscription signup login paywall sidebar side rail widget menu nav"
    " navbar navigation breadcrumb breadcrumbs pager pagination toolbar share sharing social comment comments respond replies reply"
    " disqus footer foot header masthead topbar related recommended recommendations teaser teasers trending copyright legal skip search".split()
)
#: Parts that take that mark away from the one name they stand in, as in "has-sidebar", "no-header" and "comments-off".
_ABOUT = frozenset("has with no without hide off open closed".split())
#: Marks that say little where they are a part of a longer name, as in "legal-text" and "search-result".
_WEAK = frozenset("legal search notice notices header head top side share social copyright skip".split())
#: Names of holders that may be written on to a mark, as in "commentlist" and "adbox".
_ENDINGS = tuple("list lists box boxes bar bars area wrap wrapper container block blocks section unit slot panel form links item items row body".split())
#: The end of a word in a name that changes case, as in "userComments".
_CASE = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_LINK = re.compile(r"""(?:^|\s)href\s*=""", re.IGNORECASE)
_ANCHOR = re.compile(r"""(?:^|\s)(?:name|id)\s*=""", re.IGNORECASE)


@dataclass
class Block:
    text: str
    words: int
    linked: float
    #: -1 inside a frame such as a menu, 1 inside an article, 0 neither
    place: int
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _marks(part: str) -> bool:
    """True for a part of a name that marks surroundings, by itself or with the name of a holder written on to it."""
    return part in _WORDS or any(part.endswith(e) and part[: -len(e)] in _WORDS for e in _ENDINGS)


@lru_cache(maxsize=4096)
def _named(name: str) -> int:
    """What one class, id or role says: -2 if all of it marks surroundings, -1 if a part does, 1 for the main text, else 0."""
    if name.lower() == "main":
        return 1
    parts = _PARTS.findall(_CASE.sub("-", name).lower())
    marked = [p for p in parts if _marks(p)]
    if not marked or not _ABOUT.isdisjoint(parts):
        return 0
    if len(marked) == sum(p not in _ENDINGS for p in parts):
        return -2
    return 0 if _WEAK.issuperset(marked) else -1


def _place(tag: str, attributes: str) -> int:
    """-1 for a frame such as a menu, 1 for a holder of the article, 0 for neither.

    An article or main element is a frame only if a whole name says so, as "comment" does, or if it is
    hidden: parts of its names, as in "tag-search" and "comment-open", tell of other things.
    """
    if tag in _WHOLE:
        return 0
    if tag in _FRAME or (attributes and _HIDDEN.search(attributes)):
        return -1
    said = [0]
    if attributes and "=" in attributes:
        said += [_named(name) for m in _HINT.finditer(attributes) for name in (m.group(1) or m.group(2) or m.group(3) or "").split()]
    if tag in _CONTENT:
        return -1 if min(said) == -2 else 1
    return -1 if min(said) < 0 else max(said)


def _pieces(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """The page in order: (text, "", False, "") and ("", name, shut, attributes), in one pass."""
    at, end = 0, len(page)
    quotes = True
    endless: set[str] = set()
    while at < end:
        start = page.find("<", at)
        while start >= 0 and page[start + 1 : start + 2] not in _OPENERS:
            start = page.find("<", start + 1)
        if start < 0:
            start = end
        if start > at:
            yield page[at:start], "", False, ""
        if start == end:
            return
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 2)
            at = end if stop < 0 else stop + 3
            continue
        m = _NAME.match(page, start + 1)
        if not m:
            stop = page.find(">", start)
            at = end if stop < 0 else stop + 1
            continue
        rest = _REST.match(page, m.end()) if quotes else None
        if rest:
            attributes, at = rest.group(1), rest.end()
        else:
            # a quote that is never closed: from here on a tag ends at the first ">"
            quotes = False
            stop = page.find(">", m.end())
            attributes, at = page[m.end() : stop], stop + 1
            if stop < 0:
                return
        name, shut = m.group(2).lower(), bool(m.group(1))
        if name in _RAW and not shut and not attributes.rstrip().endswith("/") and name not in endless:
            close = _closing(name).search(page, at)
            if close:
                stop = page.find(">", close.end())
                at = end if stop < 0 else stop + 1
            elif name in _RAW_TEXT:
                at = end
            else:
                endless.add(name)
        yield "", name, shut, attributes


@lru_cache(maxsize=64)
def _closing(name: str) -> re.Pattern:
    return re.compile(f"</{name}\\b", re.IGNORECASE)


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order; text may stand outside of any tag, tags may be left open.

    A tag that the page ends in is markup without text.  In a header of an article the headings are the
    article's.  A link goes on over blocks inside of it, up to its end, the next link, or the end of the
    block that it began in; an anchor without an address is none.
    """
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    pieces: list[tuple[str, bool]] = []
    links = frames = articles = heads = inner = 0
    heading = False

    def close() -> None:
        if pieces:
            text = " ".join("".join([p for p, _ in pieces]).split())
            if text:
                linked = sum(len(p.split()) for p, link in pieces if link)
                words = text.count(" ") + 1
                framed = frames or (heads and not heading)
                out.append(Block(text, words, min(linked, words), -1 if framed else 1 if articles else 0, heading))
            pieces.clear()

    for text, name, shut, attributes in _pieces(page or ""):
        if not name:
            pieces.append((html.unescape(text) if "&" in text else text, links > 0))
            continue
        if name == "a":
            links = 0 if shut or (_ANCHOR.search(attributes) and not _LINK.search(attributes)) else 1
            inner = 0
            continue
        if name in _BLOCKS:
            close()
            if links:
                if not shut:
                    inner += 1
                elif inner:
                    inner -= 1
                else:
                    links = 0
            if name[0] == "h" and name[1:].isdigit():
                heading = not shut
            elif not shut:
                heading = False
        elif name == "br":
            pieces.append((" ", False))
        if name in _BLOCKS and not shut and stack and stack[-1][0] in ("p", "li") and (stack[-1][0] == "p" or name == "li"):
            # an open paragraph ends before the next block, an open item before the next item
            n, kind = stack.pop()
            opened[n] -= 1
            frames -= kind < 0
            articles -= kind == 1
        if name in _HOLDERS:
            if not shut:
                if not attributes and name in ("p", "span", "li") and not opened[name]:
                    continue
                kind = 2 if name == "header" and articles and not frames else _place(name, attributes)
                stack.append((name, kind))
                opened[name] += 1
                frames += kind < 0
                articles += kind == 1
                heads += kind == 2
            elif opened[name]:
                while True:
                    n, kind = stack.pop()
                    opened[n] -= 1
                    frames -= kind < 0
                    articles -= kind == 1
                    heads -= kind == 2
                    if n == name:
                        break
    close()
    return out


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "place", "heading", "article")

#: The labelled table: the blocks of a page a line.  A block is + (of the article) or -, its words, / and
#: its link density unless that is 0, h if it is a heading, and where it stands: a in an article, f in a frame
#: such as a menu, nothing elsewhere.
LAYOUTS = """
-6/1f -1/1f -1/1f +10ha +60a +45a +2a +70a +4ha +35/0.2a -14/0.1f -25f
-9f -3f +9ha +55a +1a +70a +120/0.02a -40f -60f -9hf -45f -3/1f
-1/1f +8ha +1a +1a +2a -70f +12/0.9a +40a +3/1a +60a -120/0.1f
-20f +6ha +150/0.01a -60f -18f +80a +9/0.1a +14a
-2hf -2f +12a +200a -200f +100a -90f -4f -50f +3a
-5 -2/1 -60 +7ha +50a +20a +1a -9h -30 -45 -60/0.1
-1/1 -1/1 +10ha +90a +4ha +30/0.5a +5/1a +60a -12 -70 -3h
+8/1a +40a +1a +2/1a +1/1a -4/1 -80
+3ha +2/1a +4a +6/1a +60a +3a +5/1a
-1/1 -3 -1/1 +8ha +4/1a +1a +1/1a +2a +2/1a -6 -1/1
-4/1 -2 -3/1 +5a +3/1a -9f -2/1 -6 -1/1
+6a +4/1a +8/0.5a +9a +7/1a +1a +1/1a
-1/1f -1/1f -12f +8h +60 +45/0.05 +25 +3 +70 +5h +50 -14f -40f -6/1f
-10f -60f +9h +90 +2 +1 +120/0.1 -45f -25f
-30f +4h +20/0.3 +45 +6 +40 -90f -1/1f
-1/1 -1/1 -2/1 -1/1 -1/1 +8h +60 +45 +80 +6h +70 +5 -2/1 -3/1 -1/1
-4/1 -1/1 -3/1 +1h +50 +2 +65/0.1 +30 -1/1 -1/1
-1/1 -2/1 -1/1 +60 +20 -2/1
-2/1 +30 +90 +4 +110/0.05 -3/1 -3/1
-1/1 +2h +1 +60
+2h +1 +60
+2h +1 +60 +3 +40
+6h +3 +5 +80 +2
+60 -2/1
+60 -1/1 -1/1 -1/1
+25 -2/1
+40 +12 -5/1
+12
+3
+1
+90
+60 +50
+20/0.3 +45 +40
+10h +70 +6h +50/0.1 +45 -6h -8/0.9 -9/1 -5/0.8 -7/1
+9h +55 +35/0.2 -8/0.8 -12/0.9 -20/0.7 -5/1
-1/1 -1/1 -3 -1/1 -1/1 +11h +75 +60 -4/0.5 -3/1 -2/1
-1/1 -2/1 -2/1 +60 -1/1 -2/1 -2/1
-2/1 +30 -2/1
-1/1 +22 -1/1 -1/1
-1/1 -3 -1/1 -1/1
-2/1 -5 -2/1
-1/1 -6 -1/1
-3/1 -2/1 -8/0.8 -3/1 -1/1 -4/1
-1/1 -1/1 -1/1 -1/1
-20/0.7 -8/0.9 -4/1 -30/0.9
-6/1 -40/0.95 -25/0.8
+5h +8 +9 +30 +4 +12
+7h +4 +45/0.1 +3 -1/1 -1/1 -2/1
+1h +60 +2 +2 -1/1
+6h +60 +4 +2 -2/1 -2/1
+8h +70 +3 +5 +2 -1/1 -3/1 -1/1
+60 +3 +2 -5/1
+60 -60/1 -5/1 -60/1 -5/1
-3 -4 -2/1 -60/1 +60 +3 +60
"""

_LAYOUT = re.compile(r"([+-])([0-9]+)(?:/([0-9.]+))?(h?)([af]?)")


def _described(found: list[Block]) -> np.ndarray:
    """FEATURES of the blocks of a page; beyond its ends there is a block of no words."""
    own = np.array([(0.0, 0.0), *((b.words, b.density) for b in found), (0.0, 0.0)])
    rest = np.array([(b.place, b.heading) for b in found], float)
    article = np.full((len(found), 1), float(any(b.place > 0 for b in found)))
    return np.hstack([own[1:-1], own[:-2], own[2:], rest, article])


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of all layouts."""
    x, y = [], []
    for line in LAYOUTS.strip().splitlines():
        parts = [_LAYOUT.fullmatch(t).groups() for t in line.split()]
        x.append(_described([Block("", int(n), int(n) * float(d or 0), {"a": 1, "f": -1, "": 0}[where], bool(h)) for _, n, d, h, where in parts]))
        y.extend(sign == "+" for sign, *_ in parts)
    return np.vstack(x), np.array(y, float)


def _grow(x: np.ndarray, y: np.ndarray, depth: int):
    """A tree of (feature, cut, low, high) and leaves by the least Gini impurity; ties take the first feature."""
    if depth == 0 or y.min() == y.max():
        return bool(y.mean() > 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= t
            p, q = y[low].mean(), y[~low].mean()
            impurity = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
            if best is None or impurity < best[0] - 1e-9:
                best = (impurity, f, float(t))
    if best is None:
        return bool(y.mean() > 0.5)
    _, f, t = best
    low = x[:, f] <= t
    return f, t, _grow(x[low], y[low], depth - 1), _grow(x[~low], y[~low], depth - 1)


@lru_cache(maxsize=1)
def tree():
    """The decision tree grown from the labelled table."""
    return _grow(*labelled(), 8)


def main_text(page: str | None) -> str:
    """The blocks of the article joined by line feeds; empty if there are none."""
    found = blocks(page)
    kept = []
    for b, x in zip(found, _described(found).tolist() if found else (), strict=True):
        node = tree()
        while isinstance(node, tuple):
            f, t, low, high = node
            node = low if x[f] <= t else high
        if node:
            kept.append(b.text)
    return "\n".join(kept)


def extract(df: DataFrame, html_column: str = "html", out: str = "text", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep``, the main text of ``html_column`` and ``n_chars``, its code points.

    Null and empty pages and pages without an article's text give the empty text; a page of any length
    is read once, whole; repeated rows give repeated rows; other columns are ignored; an empty table
    gives none.
    """
    df = df.select(*keep, html_column)
    fields = [f for f in df.schema.fields if f.name in keep]

    def run(batches):
        for part, pages in text_batches(batches, html_column):
            texts = [main_text(p) for p in pages]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*keep, out, "n_chars"],
            )

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())]))
