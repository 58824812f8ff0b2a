"""Main text of web pages by the distribution of text over lines."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from statistics import median
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines summed together; the part of the usual sum at which text surges or dives; a line weighs at
#: most so many times the usual one, so a single block cannot set the scale.
WINDOW = 3
SURGE = 0.05
HEAVIEST = 4

# Elements of HTML by what they mean for the text. Raw ones hold no text of the
# article: code, the page's title, form parts, and what a page shows only where something fails.
RAW = "script style template title textarea xmp noscript iframe object canvas audio video"
CHROME = "nav header footer aside form button select menu dialog datalist fieldset head"
HEADINGS = "h1 h2 h3 h4 h5 h6"
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr input nobr "
    "math mi mn mo mrow mtext msup msub mfrac msqrt semantics"
)
VOID = "area base br col embed hr img input link meta param source track wbr"
# Words in class, id or role that mark what surrounds an article.
CHROME_WORDS = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer header masthead "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond replies pagination pager toolbar copyright "
    "complementary contentinfo search"
)
# Words that change nothing about a name they stand in.
NEUTRAL_WORDS = (
    "area articles bar block body bottom box button buttons center col column container content desktop "
    "form global group icon icons inner item items left link links list main mobile module outer page "
    "panel posts primary right row secondary section site slot stories thread toggle top unit wrap "
    "wrapper zone"
)
# Names of what readers or sellers add, also where a heading says the same.
ADDED_WORDS = (
    "comment comments commentlist disqus respond replies related recommended recommendations share "
    "sharing social subscribe newsletter signup login cookie cookies sponsored"
)
RAW_TAGS, CHROME_TAGS, HEADING_TAGS, INLINE_TAGS, VOID_TAGS, CHROME_NAMES, NEUTRAL_NAMES, ADDED_NAMES = (
    frozenset(x.split())
    for x in (RAW, CHROME, HEADINGS, INLINE, VOID, CHROME_WORDS, NEUTRAL_WORDS, ADDED_WORDS)
)
BOX_TAGS = frozenset(("article", "main"))

_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(sorted(RAW_TAGS))})\b{_ATTRIBUTES}(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:.-]*)(?P<attributes>{_ATTRIBUTES})>",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(
    r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE
)
_HEADING = re.compile(rf"\s*<h[1-6]\b{_ATTRIBUTES}>(.*?)</h[1-6]\s*>", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(rf"<{_ATTRIBUTES}>")
# A stroke that is not the end of a bare value, as in href=/.
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")

# Words in a name by which it speaks of something else on the page.
_ABOUT = frozenset(("has", "no", "with", "without"))
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(name)]


def is_chrome_name(words: list[str], whole: bool) -> bool:
    """Whether a name of these words is one of the surroundings: for any word of theirs or, read as
    a ``whole``, for its last word or if its other words are neutral."""
    if CHROME_NAMES.isdisjoint(words) or not _ABOUT.isdisjoint(words):
        return False
    return not whole or words[-1] in CHROME_NAMES or CHROME_NAMES.union(NEUTRAL_NAMES).issuperset(words)


def is_chrome(attributes: str, tag: str = "div", inside: bool = False, html: str = "", at: int = 0) -> bool:
    """Whether class, id, role or style say that an element is not part of the article.

    Inside an article, and in ids (which are often made from titles), a name counts as a whole
    only: ``related-work`` is none, ``related`` and ``related-posts`` are. Ids of headings never
    count, nor do ids of elements that begin (in ``html`` from ``at`` on) with a heading of the
    same words, unless they name what readers or sellers add.
    """
    if not attributes:
        return False
    for kind, a, b, c in _NAMED.findall(attributes):
        is_id = kind.lower() == "id"
        if is_id and tag in HEADING_TAGS:
            continue
        for name in (a or b or c).split():
            words = _words(name)
            if not is_chrome_name(words, inside or is_id):
                continue
            if is_id and ADDED_NAMES.isdisjoint(words):
                heading = _HEADING.match(html, at)
                if heading and _words(_TAG.sub(" ", heading[1]).title()) == words:
                    continue
            return True
    return bool(_HIDDEN.search(attributes))


class Line(NamedTuple):
    """The text of a block; whether it lies in surroundings, and whether in such inside its outermost
    box; how many of its characters are links; the boxes it lies in, outermost first."""

    text: str
    chrome: bool
    inner: bool
    linked: int
    boxes: tuple[int, ...]


def lines_of(html: str) -> tuple[list[Line], list[str]]:
    """Every block in page order, and the tags of the boxes (article and main elements).

    Blocks of the surroundings are kept as lines so that they leave a gap in the distribution.
    """
    lines: list[Line] = []
    kinds: list[str] = []
    parts: list[str] = []
    linked = [0, 0]  # characters of links in this block, and open links
    # Open elements: their names, and what holds inside them.
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []
    opened: Counter[str] = Counter()

    def state() -> tuple[bool, bool, tuple[int, ...]]:
        return stack[-1][1:] if stack else (False, False, ())

    def add(text: str) -> None:
        parts.append(text)
        if opened["a"]:
            linked[0] += len(text.strip())

    def end_line() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            lines.append(Line(text, state()[0], state()[1], min(linked[0], len(text)), state()[2]))
        linked[0] = 0

    at = 0
    for token in _TOKEN.finditer(html):
        add(html[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        inline = tag in INLINE_TAGS
        if token["end"]:
            if not opened[tag]:
                if not inline:
                    end_line()
                continue
            depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
            after = stack[depth - 1][1:] if depth else (False, False, ())
            if not inline or state() != after:
                end_line()
            for closed in stack[depth:]:
                opened[closed[0]] -= 1
            del stack[depth:]
            continue
        if tag == "body":  # whatever the head left open ends here
            end_line()
            stack.clear()
            opened.clear()
        chrome, inner, boxes = state()
        within = bool(boxes)
        marks = tag != "body" and (
            tag in CHROME_TAGS or is_chrome(token["attributes"], tag, within, html, token.end())
        )
        if not inline or marks:
            end_line()
        if tag in VOID_TAGS or _CLOSED.search(token["attributes"]):
            continue
        if tag in BOX_TAGS:
            boxes = (*boxes, len(kinds))
            kinds.append(tag)
        stack.append((tag, chrome or marks, bool(boxes) and (inner or marks), boxes))
        opened[tag] += 1
    add(html[at:])
    end_line()
    return lines, kinds


def stretch(lengths: list[int]) -> tuple[int, int]:
    """From the first line where text surges to the line after which it has dived for good.

    Lengths (0 for what is no text of an article) are capped at ``HEAVIEST`` times their median
    and summed over ``WINDOW`` lines. Text surges with the first sum that reaches ``SURGE`` of the
    sums' median, and dives with the last one that does.
    """
    heaviest = HEAVIEST * median(n for n in lengths if n)
    weights = [min(n, heaviest) for n in lengths]
    sums = [sum(weights[max(0, i) : i + WINDOW]) for i in range(1 - WINDOW, len(weights))]
    least = SURGE * median(n for n in sums if n)
    dense = [i for i, n in enumerate(sums) if n >= least]
    reached = range(max(0, dense[0] + 1 - WINDOW), min(len(lengths), dense[-1] + 1))
    with_text = [i for i in reached if lengths[i]]
    return with_text[0], with_text[-1] + 1


def main_text(html: str) -> str:
    """The article: all lines between the points where text surges and dives for good, but for the
    surroundings among them.

    Text in links does not count for the surge and the dive, so menus without a mark stay outside.
    If one article or main element holds more than half of that text (the innermost such), its
    edges are the article's. Articles inside what was found, beside more text of its own, are
    teasers or readers' comments and left out. A ``header`` is surroundings, in an article as well;
    so are ``noscript`` and other texts for browsers that cannot show something.
    """
    lines, kinds = lines_of(html)
    usable = [not line.chrome for line in lines]
    if not any(u and line.boxes for u, line in zip(usable, lines)):
        # Surroundings that nobody closed must not swallow the article.
        usable = [not (line.inner if line.boxes else line.chrome) for line in lines]
    lengths = [len(line.text) * u for line, u in zip(lines, usable)]
    if not any(lengths):
        return ""
    plain = [max(0, n - line.linked) for n, line in zip(lengths, lines)]
    first, last = stretch(plain if any(plain) else lengths)
    held: Counter[int] = Counter()
    for line, n in zip(lines[first:last], lengths[first:last]):
        held.update(dict.fromkeys(line.boxes, n))
    most = sum(lengths[first:last]) / 2
    # Boxes that hold more than half lie in one another: the last one opened is the innermost.
    box = max((b for b, n in held.items() if n > most), default=None)
    kept = [
        i for i, line in enumerate(lines)
        if lengths[i] and (first <= i < last if box is None else box in line.boxes)
    ]

    def own(line: Line) -> bool:
        after = line.boxes if box is None else line.boxes[line.boxes.index(box) + 1 :]
        return not any(kinds[b] == "article" for b in after)

    of_its_own = [i for i in kept if own(lines[i])]
    if sum(lengths[i] for i in of_its_own) * 2 > sum(lengths[i] for i in kept):
        kept = of_its_own
    return "\n".join(lines[i].text for i in kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page.

    A null or empty page, or one without an article, has the empty text; repeated rows and
    null ids give a row each, an empty table none; other columns are not read. Pages of any length
    are read whole, one after the other, so a task holds one page at a time beside its batch.
    """
    schema = "page_id bigint, url string, text string, n_chars bigint"

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        "url",
        F.coalesce("html", F.lit("")).alias("html"),
    )
    return rows.mapInArrow(extracted, schema)
