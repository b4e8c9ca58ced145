"""Main text of a page: the best contiguous stretch of its tokens.

A page is a row of tokens, words and tags. A word scores by where it stands (the
elements around it and their names, the length of its block, the share of links
in it), and positive where labelled pages have main text; tags never score above
zero. The weights are fitted on labelled pages. One linear scan finds the stretch
with the largest sum, which is the content region. Inside it, the same weights
tell which elements are none of the text (adverts, forms, comment sections ...);
what remains is joined block by block.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import pages as labelled

SCHEMA = "page_id long, url string, text string, n_chars long"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw text up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe template svg xmp noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose name is a feature of the words in them.
STRUCTURE = frozenset("nav header footer aside form menu dialog button select option label fieldset canvas object article main a".split())
#: The word after one of these is no name of an element: has-sidebar, no-comments.
ABOUT = frozenset("has have no not with without hide show is".split())
#: Elements that hold main text as a whole.
INSIDE = frozenset("article main".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
NO_LETTER = re.compile(r"[^a-z]+")
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An end tag or an implied end does not reach past these.
WALLS = frozenset("html body div section article main table ul ol dl nav aside header footer form blockquote".split())
BLOCK_STARTS = frozenset("p div section article main table ul ol dl nav aside header footer form blockquote h1 h2 h3 h4 h5 h6 pre hr figure address".split())


def marks(attributes: str) -> tuple[frozenset[str], bool]:
    """The words of an element's class, id and role, and whether it is hidden."""
    found, hidden = set(), False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name in ("hidden", "aria-hidden"):
            hidden |= name == "hidden" or value == "true"
        elif name == "style":
            hidden |= bool(HIDING.search(value))
        elif name == "role":
            found |= {f"role {x}" for x in value.split()}
        else:
            for whole in value.split():
                parts = NO_LETTER.split(whole)
                found |= {x for x, before in zip(parts, ["", *parts], strict=False) if len(x) > 1 and before not in ABOUT and x not in ABOUT}
    return frozenset(found), hidden


class Element:
    """An open element: its name and marks, what stands around it, and whether it holds a heading or article."""

    __slots__ = ("name", "marks", "hidden", "parent", "block", "holds", "held", "gone", "context")

    def __init__(self, name: str, attributes: str, parent: Element | None):
        self.name, self.parent, self.holds = name, parent, False
        self.marks, self.hidden = marks(attributes) if attributes else (frozenset(), False)
        self.block = parent.block if parent and name in INLINE else name
        self.held = bool(parent and parent.held) or name in INSIDE
        self.context: frozenset[str] | None = None

    def settle(self) -> None:
        """Fill ``context`` and ``gone`` once the whole page is read; a parent is settled before its children.

        Marks on an element that holds a heading, an article or the whole page are
        features of another name: they describe the page more than a part of it.
        """
        up = self.parent
        own = set()
        if self.name in STRUCTURE:
            own.add(f"{'holds' if self.holds and self.name not in INSIDE else 'in'} {self.name}" + (" of article" if self.name == "header" and up and up.held else ""))
        if self.name not in ("html", "body"):
            own |= {f"{'holds' if self.holds else 'in'} .{x}" for x in self.marks}
        self.gone = bool(up and up.gone) or (self.hidden and not self.holds)
        around = up.context if up else frozenset()
        self.context = around if own <= around else around | own


def parse(page: str) -> list[tuple[str, str, Element, int]]:
    """(kind, what, element, start) in page order; kind is text, open or close, element what it stands in.

    A start tag stands in its own element. Elements left open end where their
    container ends; raw text (scripts, styles, text fields ...) is passed over.
    """
    root = Element("", "", None)
    stack: list[Element] = [root]
    every: list[Element] = [root]
    out: list[tuple[str, str, Element, int]] = []
    count: dict[str, int] = {}
    at, n = 0, len(page)

    def close(depth: int) -> None:
        for e in stack[depth:]:
            count[e.name] -= 1
        del stack[depth:]

    while at < n:
        m = TOKEN.match(page, at)
        start, at = at, m.end()
        end, name, attributes, text = m.groups()
        if text is not None:
            out.append(("text", text, stack[-1], start))
        elif name is None:
            if m[0].startswith("<![CDATA["):
                out.append(("text", html.escape(m[0][9:].removesuffix("]]>")), stack[-1], start))
        elif end:
            name = name.lower()
            out.append(("close", name, stack[-1], start))
            if count.get(name):
                depth = len(stack) - 1
                while stack[depth].name != name and (name in WALLS or stack[depth].name not in WALLS):
                    depth -= 1
                if stack[depth].name == name:
                    close(depth)
        else:
            name = name.lower()
            closes = CLOSES.get(name, ()) or ({"p"} if name in BLOCK_STARTS else ())
            if any(count.get(x) for x in closes):
                depth = len(stack) - 1
                while depth > 0 and stack[depth].name not in WALLS and stack[depth].name not in closes:
                    depth -= 1
                if depth > 0 and stack[depth].name in closes:
                    close(depth)
            e = Element(name, attributes, stack[-1])
            every.append(e)
            out.append(("open", name, e, start))
            if name in INSIDE or name == "h1":
                up = e.parent
                while up and not up.holds:
                    up.holds = True
                    up = up.parent
            if name in RAW:
                shut = _end_of(name).search(page, at)
                at = shut.end() if shut else n
            elif name not in VOID and not attributes.rstrip().endswith("/"):
                stack.append(e)
                count[name] = count.get(name, 0) + 1
    for e in every:  # in page order, so that parents come first
        e.settle()
    return out


@functools.cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I)


def shape_of(block: str) -> str:
    """The sort of the element that directly holds a block of text."""
    return block if block in ("p", "li", "pre", "blockquote") else "heading" if re.fullmatch("h[1-6]", block) else "cell" if block in ("td", "th", "dt", "dd", "caption", "figcaption") else "flow"


LENGTHS = (3, 6, 11, 25)


def features(rows: list[tuple[str, str, Element, int]]) -> list[tuple[frozenset[str], frozenset[str], int, bool]]:
    """(features of its place, of its block, number of words, whether its block is all links) of each token.

    The features of a tag start with "tag"; its number is 1.
    """
    page_has = any(kind == "open" and what in INSIDE for kind, what, *_ in rows)
    n_words = [len(what.split()) if kind == "text" else 0 for kind, what, *_ in rows]
    out: list = [None] * len(rows)
    known: dict[tuple, frozenset[str]] = {}
    block: list[int] = []

    def flush() -> None:
        total = sum(n_words[i] for i in block)
        linked = sum(n_words[i] for i in block if "in a" in rows[i][2].context)
        size = sum(total >= x for x in LENGTHS)
        share = 0 if not linked else 1 if 2 * linked < total else 2 if linked < total else 3
        for i in block:
            e = rows[i][2]
            key = (shape_of(e.block), size, share)
            own = known.get(key) or known.setdefault(key, frozenset((f"{key[0]} of size {size}", f"links {share}")))
            out[i] = (place(e), own, n_words[i], share == 3)
        block.clear()

    def place(e: Element) -> frozenset[str]:
        own = (e.context, page_has and not e.held)
        return known.get(own) or known.setdefault(own, e.context - {"in a"} | {"word"} | ({"stray word"} if own[1] else set()))

    for i, (kind, what, e, _) in enumerate(rows):
        if kind == "text":
            block.append(i)
        else:
            if what not in INLINE and what not in ("br", "img"):
                flush()
            sort = "structure" if what in ("html", "body", "head") else "inside" if what in INSIDE else "link" if what == "a" else "inline" if what in INLINE else "list" if what in ("ul", "ol", "li", "dl") else "container" if what in WALLS else "block"
            key = ("tag", sort, page_has and not e.held)
            own = known.get(key) or known.setdefault(key, frozenset((f"tag {sort}", *(("tag stray",) if key[2] else ()))))
            out[i] = (own, frozenset(), 1, False)
    flush()
    return out


#: Labelled pages of the fit, the pages that must have a name for it to be a feature, the prior's weight, and steps.
PAGES, SEEN, PRIOR, STEPS = 800, 5, 2.0, 400
#: A word counts so many times at most in one block, where it counts against the stretch and in the fit.
MOST_WORDS = 12


@functools.cache
def weights(n_pages: int = PAGES) -> dict[str, float]:
    """Weights of features, fitted on labelled pages by logistic regression.

    The weights of tags are kept at or below zero, as the method has it; those of
    words come out as the pages have them.
    """
    sums: dict[frozenset[str], list[float]] = {}
    seen: Counter[str] = Counter()
    for page in labelled(n_pages):
        inside = [mark for mark, markup in page for _ in markup]
        rows = parse("".join(markup for _, markup in page))
        own = [(where | block, n, inside[start]) for (where, block, n, _), (*_, start) in zip(features(rows), rows, strict=True) if n]
        seen.update(set().union(*(names for names, *_ in own)))
        for names, n, y in own:
            sums.setdefault(names, [0.0, 0.0])[y] += min(n, MOST_WORDS)
    names = sorted(f for f, n in seen.items() if n >= SEEN)
    index = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(sums), len(names)))
    for i, own in enumerate(sums):
        x[i, [index[f] for f in own if f in index]] = 1
    n0, n1 = np.array(list(sums.values())).T
    tag = np.array([f.startswith("tag") for f in names])
    w, m, v = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ ((n0 + n1) * p - n1) + PRIOR * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w[tag] = np.minimum(w[tag], -0.01)
    return {f: round(float(x), 3) for f, x in zip(names, w, strict=True)}


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous stretch with the largest sum; the first of equals, empty if none is positive."""
    best, here, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if here <= 0:
            here, start = 0.0, i
        here += s
        if here > best:
            best, found = here, (start, i + 1)
    return found


#: A block that tells nothing by itself.
PLAIN = ("p of size 3", "links 0")


def scores(rows: list, w: dict[str, float]) -> list[tuple[float, bool]]:
    """The score of each token, and whether it is left out of a region around it.

    What stands in an element whose name or marks alone speak against it is left
    out and counts nothing, so that an advert does not cut a text in two. Other
    words that are no main text count against the region around them, by
    MOST_WORDS of a stretch at most; they are left out if their block is all links.
    """
    of = functools.cache(lambda names: sum(w.get(f, 0.0) for f in sorted(names)))
    stray = any(kind == "open" and what in INSIDE for kind, what, *_ in rows)
    against = functools.cache(lambda names, out: of(names) + (w.get("stray word", 0.0) if out else 0.0) + of(PLAIN) < 0)
    out = []
    for (where, block, n, all_links), (kind, _, e, _) in zip(features(rows), rows, strict=True):
        one = of(where) + of(block)
        if e.gone or against(e.context - {"in a"} | {"word"}, stray and not e.held):
            out.append((0.0, True))
        elif kind != "text":
            out.append((one, False))
        else:
            out.append((one * (n if one > 0 else min(n, MOST_WORDS)), all_links and one < 0))
    return out


def whole_blocks(rows: list, lo: int, hi: int) -> tuple[int, int]:
    """The stretch without cutting a block at either end."""
    inside = lambda i: rows[i][0] == "text" or rows[i][1] in INLINE
    while 0 < lo < hi and inside(lo) and inside(lo - 1):
        lo -= 1
    while lo < hi < len(rows) and inside(hi - 1) and inside(hi):
        hi += 1
    return lo, hi


def main_text(page: str | None, w: dict[str, float] | None = None) -> str:
    """The main text of a page, one space between words; empty for null, empty or contentless pages."""
    if not page:
        return ""
    rows = parse(page)
    scored = scores(rows, weights() if w is None else w)
    lo, hi = whole_blocks(rows, *best_stretch([s for s, _ in scored]))
    out: list[str] = []
    for (kind, what, *_), (_, left_out) in zip(rows[lo:hi], scored[lo:hi], strict=True):
        if kind == "text":
            if not left_out:
                out.append(html.unescape(what))
        elif what not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; a null html gives an empty text.

    Row by row and without a shuffle: ids and urls, null or repeated, pass through.
    The weights are fitted once, on the driver (some hundred numbers).
    """
    w = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, w) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, SCHEMA)
