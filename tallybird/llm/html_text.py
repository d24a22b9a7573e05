"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page is a sequence of tags and text runs. Every word scores positive, every tag negative, words in
places that never hold content (menus, adverts, forms, ...) negative too; the weights are log odds
learned from labelled pages: pages whose markup names its content (``article``, ``main``) label
themselves. One linear scan finds the contiguous run with the highest sum. The run then grows to the
element that holds it, so that a short last paragraph is not lost to its tags, and what lies in menus,
adverts and the like inside it is left out. Where a class or id only begins with a word such as ``notice``,
the learned weight of such places tells whether their words are content.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybird.llm.texts import whole_text

SAMPLE = 2000  # labelled pages the weights are learned from

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg object select".split())
NEVER = frozenset(
    "head nav footer aside form dialog menu menuitem canvas audio video datalist".split()
) | RAW
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
_CONTAINERS = frozenset("article main section div td body html center".split())
#: Words of class and id names that mark what is no content.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted cookie cookies "
    "consent gdpr notice notices popup modal overlay newsletter subscribe signup sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs masthead footer comment comments commentlist disqus replies respond share sharing social "
    "related recommended recommendations toolbar pager pagination login search alert skip topbar".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>"
    r"""|<(/?)([A-Za-z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>"""
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_CUT_OFF = re.compile(r"</?[A-Za-z]|<!|<\?")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WHITE = re.compile(r"\s+")


class Item(NamedTuple):
    """A tag (text is None) or a text run."""

    text: str | None
    words: int
    place: str  # what its weight is looked up by
    element: int  # number of the innermost open element, -1 for none
    content: bool  # not in a menu, advert, ...
    separates: bool  # a block tag


class Element(NamedTuple):
    """An element, with what its ancestors say, so that nobody climbs to them."""

    tag: str
    content: bool
    parent: int
    block: str  # the innermost block tag
    link: bool  # in a link
    doubtful: bool  # in a place whose name only begins like one without content
    article: bool  # in an article
    top: str | None  # the outermost tag but html and body


_PAGE = Element("", True, -1, "body", False, False, False, None)


def _marked(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether class, id, role or visibility say that an element is no content, and whether a name leaves it
    in doubt. A name says so as a whole or by its last part; an article or main element is never
    dropped for its names."""
    doubtful = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if tag not in ("html", "body", "main", "article"):
                for one in value.split():
                    parts = [word.lower() for word in _NAME.findall(one)]
                    if one.lower() in MARKS or parts and parts[-1] in MARKS:
                        return True, False
                    doubtful = doubtful or any(word in MARKS for word in parts)
        elif name == "role" and value.lower() in ROLES or name == "hidden":
            return True, False
        elif name == "aria-hidden" and value.lower() == "true":
            return True, False
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return True, False
    return False, doubtful


def _is_header(attributes: str) -> bool:
    """Whether class or id name a page's header; within an article it would be the article's."""
    return any(
        name.lower() in ("class", "id") and any(word.lower() == "header" for word in _NAME.findall(value))
        for name, value in _ATTRIBUTE.findall(attributes)
    )


def read_page(page: str) -> tuple[list[Item], list[Element]]:
    """Tags and text runs in page order, with the elements they lie in. Elements left open end with
    the one around them; a block ends an open paragraph; end tags without a start are ignored."""
    items: list[Item] = []
    elements: list[Element] = []
    stack: list[int] = []
    opened: dict[str, int] = defaultdict(int)  # how many of a tag are open
    at = 0

    def around() -> Element:
        return elements[stack[-1]] if stack else _PAGE

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[elements[e].tag] -= 1
        del stack[k:]

    def text(run: str) -> None:
        e, own = around(), stack[-1] if stack else -1
        if run and not run.isspace():
            place = f"{e.block}{' a' if e.link else ''}{' ?' if e.doubtful else ''}{'' if e.content else ' -'}"
            items.append(Item(run, len(run.split()), place, own, e.content, False))
        elif run:
            items.append(Item(run, 0, "white", own, e.content, False))

    def tag_item(name: str, end: str, separates: bool) -> None:
        place = f"<{end}{name if name in BLOCKS or name in NEVER or name in ('a', 'b', 'i', 'em', 'strong', 'span') else 'other'}>"
        items.append(Item(None, 0, place, stack[-1] if stack else -1, around().content, separates))

    last = page.rfind(">") + 1  # no tag ends behind it; one that starts there is cut off
    while True:
        found = _TOKEN.search(page, at, last)
        if not found:
            cut = _CUT_OFF.search(page, max(at, last))
            text(page[at : cut.start() if cut else len(page)])
            return items, elements
        text(page[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if found[1] or found[4]:
            tag_item(name, "/", name in BLOCKS)
            if opened[name]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if elements[stack[k]].tag == name))
            continue
        attributes = found[3] or found[6] or ""
        if name in BLOCKS and name not in ("br", "html", "body"):
            ends = ("p", "li") if name == "li" else ("p",)
            for k in range(len(stack) - 1, -1, -1) if any(opened[tag] for tag in ends) else ():
                tag = elements[stack[k]].tag
                if tag in ends:
                    close(k)
                    break
                if tag in _CONTAINERS or tag in ("ul", "ol", "blockquote", "table"):
                    break
        outer = around()
        dropped, doubtful = _marked(name, attributes)
        is_content = outer.content and name not in NEVER and not dropped
        if not outer.article and (name == "header" or name in ("div", "section") and _is_header(attributes)):
            is_content = False
        if name not in VOID:
            elements.append(
                Element(
                    name,
                    is_content,
                    stack[-1] if stack else -1,
                    name if name in BLOCKS else outer.block,
                    outer.link or name == "a",
                    outer.doubtful or doubtful,
                    outer.article or name == "article",
                    outer.top or (name if name not in ("html", "body") else None),
                )
            )
            stack.append(len(elements) - 1)
            opened[name] += 1
        tag_item(name, "", name in BLOCKS)
        if name in RAW and not attributes.rstrip().endswith("/"):
            # its inside is no markup; without an end it takes the rest of the page
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
        elif attributes.rstrip().endswith("/") and name in ("svg", "math"):
            close(len(stack) - 1)


def _within(elements: list[Element], chosen: set[int]) -> list[bool]:
    """Whether each element is one of ``chosen`` or lies in one; the last entry is for no element."""
    out: list[bool] = []
    for k, e in enumerate(elements):
        out.append(k in chosen or e.parent >= 0 and out[e.parent])
    return [*out, False]


def places_seen(page: str) -> dict[str, list[int]] | None:
    """Words and tags inside and outside the labelled content by place; None without a label."""
    items, elements = read_page(page)
    labels = [k for k, e in enumerate(elements) if e.content and e.tag == "article"]
    labels = labels or [k for k, e in enumerate(elements) if e.content and e.tag == "main"]
    if not labels:
        return None
    inside = _within(elements, set(labels))
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for item in items:
        counts[item.place][not inside[item.element]] += item.words if item.text is not None else 1
    return counts


def weigh(place: str, inside: int, outside: int) -> float:
    """Log odds of lying in the content, kept positive for words, negative for tags and for words in
    places that are no content; in doubtful places words have the sign they are learned to have."""
    odds = math.log((inside + 1) / (outside + 1))
    if place.startswith("<"):
        return min(-0.1, max(odds, -8.0)) if odds < 0 else -0.1
    if place.endswith(" -"):
        return -2.0
    if place.endswith(" ?"):
        return max(-2.0, min(odds, 2.0))
    return max(0.1, min(odds, 2.0))


def learn_weights(pages: DataFrame, page: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights by place, from at most ``sample`` pages, those with the smallest text hashes. The
    places are names of known tags, so the table is small."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for value in batch.column("html").to_pylist():
                for place, (inside, outside) in (places_seen(value) or {}).items():
                    total[place][0] += inside
                    total[place][1] += outside
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(total), pa.string()),
                    pa.array([v[0] for v in total.values()], pa.int64()),
                    pa.array([v[1] for v in total.values()], pa.int64()),
                ],
                names=["place", "inside", "outside"],
            )

    texts = pages.select(whole_text(pages, page).alias("html"))
    chosen = texts.select(F.xxhash64("html").alias("h")).distinct().orderBy("h").limit(sample)
    counted = (
        texts.withColumn("h", F.xxhash64("html"))
        .join(F.broadcast(chosen), "h")  # at most ``sample`` hashes
        .dropDuplicates(["h"])
        .select("html")
        .mapInArrow(count, "place string, inside long, outside long")
        .groupBy("place")
        .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    )
    return {r["place"]: weigh(r["place"], r["inside"], r["outside"]) for r in counted.collect()}


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and past-last place of the contiguous run with the highest sum (the first of equals);
    (0, 0) if no sum is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, span = total, (start, k + 1)
    return span


def _holder(items: list[Item], elements: list[Element], low: int, high: int) -> int | None:
    """The element the run belongs to: the outermost article around its content, else the main
    element, else the innermost container of all of it; None for the page's body."""
    inside = [0] * len(elements)
    total = 0
    for i in items[low:high]:
        if i.text is not None and i.words and i.content:
            total += 1
            if i.element >= 0:
                inside[i.element] += 1
    for k in range(len(elements) - 1, -1, -1):
        if elements[k].parent >= 0:
            inside[elements[k].parent] += inside[k]
    common = [k for k, n in enumerate(inside) if n == total]  # one in another, the outermost first
    for tag in ("article", "main"):
        around = [e for e in common if elements[e].tag == tag]
        if around:
            return around[0]
    while common and elements[common[-1]].tag not in _CONTAINERS:
        common.pop()
    return common[-1] if common and elements[common[-1]].tag not in ("body", "html") else None


def main_text(page: str, weights: dict[str, float]) -> str:
    """The content of one page, white space made single spaces; empty if nothing scores."""
    items, elements = read_page(page)
    scores = []
    for k, item in enumerate(items):
        if item.place.endswith(" ?") and weights.get(item.place, 0.0) < 0:
            item = items[k] = item._replace(content=False)
        known = weights.get(item.place)
        if item.text is None:
            scores.append(-0.5 if known is None else known)
        else:
            default = 0.5 if item.content else -2.0
            scores.append(item.words * (default if known is None else known))
    low, high = best_run(scores)
    if low == high:
        return ""
    holder = _holder(items, elements, low, high)
    if holder is not None:
        inside = _within(elements, {holder})
        chosen = [i for i in items if inside[i.element]]
    else:
        # straight in the body: paragraphs and headings beside the run belong to it
        def joins(item: Item) -> bool:
            top = elements[item.element].top if item.element >= 0 else None
            return item.content and (item.text is None or not item.words or top in _PARAGRAPHS)

        while low > 0 and joins(items[low - 1]):
            low -= 1
        while high < len(items) and joins(items[high]):
            high += 1
        chosen = items[low:high]
    parts = []
    for item in chosen:
        if item.text is None:
            parts.append(" " if item.separates else "")
        else:
            parts.append(html.unescape(item.text) if item.content else " ")
    return _WHITE.sub(" ", "".join(parts)).strip()


def extract_text(pages: DataFrame, page: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of every whole page in column ``name``, ``page`` left out.

    A null or empty page, and one without content, gives an empty text. Pages that are cut off or
    badly nested are read as far as they go. Repeated rows give equal texts; other columns pass
    through; an empty table gives an empty one.
    """
    weights = learn_weights(pages, page)
    rest = [c for c in pages.columns if c not in (page, name)]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py() or "", weights) for value in batch.column(page)]
            kept = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[*rest, name])

    kinds = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest] + [f"`{name}` string"])
    return pages.select(*rest, whole_text(pages, page).alias(page)).mapInArrow(extract, kinds)
