"""The main text of HTML pages by tag-path ratios.

A page is read into blocks of text, each with its tags from the root down. Over
all blocks of one path, text length and punctuation are summed and divided by
the number of blocks, links count against their path. The ratios are smoothed
along the page, fused, and paths above the threshold hold the content; a block
under the same article as content belongs to it, whatever its own ratio, and
without articles so does a block between two content blocks of one parent. Blocks
under elements that say what they are (menus, forms, sidebars, adverts, notices,
reader comments, ...) are left out first. A class or id says so by one of its
words, whole or last (or first before a word for a container), but not by a
state as in ``has-sidebar``. If that would leave no text of an article, or on a
page without articles take more than half of the text, it does not count.

Each page is read alone, in one pass, whatever its length.

Defined results: NULL or empty HTML gives the empty text, as does a page without
text; an element that is never closed ends with what is around it, a tag or
comment that the page breaks off in is not text; repeated pages are extracted
each; an empty table gives an empty table; other columns are untouched.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Width of the smoothing along the page, and the share of the strongest path that content reaches.
SIGMA = 1.0
THRESHOLD = 0.2
#: What a path without punctuation is worth a character; each mark adds to it.
PLAIN = 0.5

# Elements by what they do.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that a start tag of the same kind ends.
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",)}
KEEPS = frozenset("ul ol dl table tbody thead tfoot select div section article main body".split())
BOILER_TAGS = frozenset(
    "head nav footer aside form script style template noscript button select option textarea svg canvas object "
    "iframe dialog menu title xmp noembed noframes".split()
)
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice popup modal overlay "
    "newsletter subscribe signup login share sharing social related recommended comment comments commentlist "
    "reply replies respond disqus widget copyright toolbar pager pagination skip".split()
)
#: First parts of names that tell a state, and last parts that only say container.
STATES = frozenset("has have no not is are with without show hide can".split())
CONTAINERS = frozenset(
    "area bar block body box btn button buttons container content form group header icon icons inner item items left "
    "link links list outer panel right row section slot unit wrap wrapper".split()
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|[\s\"'])(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = re.compile(r"[.,;:!?…。，、！？]")


class _Open:
    """An element that is not closed yet."""

    __slots__ = ("tag", "path", "boiler", "article", "block", "named", "ids")

    def __init__(self, tag: str, above: _Open | None, attributes: str, number: int):
        self.tag, self.block = tag, tag not in INLINE
        path = above.path if above else ()
        self.path = (*path, tag) if self.block else path
        ids = above.ids if above else ()
        self.ids = (*ids, number) if self.block else ids
        self.article = number if tag in ARTICLES else above.article if above else 0
        self.boiler = (above.boiler if above else False) or _is_boiler(tag, attributes, bool(self.article))
        #: Elements from the root down whose names say that they are not content.
        self.named = above.named if above else ()
        if _is_named(tag, attributes):
            if self.block:
                self.named = (*self.named, number)
            else:
                self.boiler = True


def _is_boiler(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in BOILER_TAGS or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    for m in _NAMED.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.strip().lower() in BOILER_ROLES:
                return True
    return False


def _is_named(tag: str, attributes: str) -> bool:
    """Whether a class or id says that an element is not content."""
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    for m in _NAMED.finditer(attributes):
        if m[1].lower() != "role":
            for name in (m[2] or m[3] or m[4] or "").split():
                parts = [w.lower() for w in _NAME_PARTS.findall(name)]
                while len(parts) > 1 and parts[-1] in CONTAINERS:
                    parts.pop()
                if parts and parts[0] not in STATES and parts[-1] in BOILER_WORDS:
                    return True
    return False


def _unnamed(found: list[tuple[tuple[int, ...], int, int]]) -> set[int]:
    """Named elements that hold the content after all, from the named elements, article and length of every block."""
    held: set[int] = set()
    while True:
        left = [([e for e in named if e not in held], article, size) for named, article, size in found]
        if any(article for _, article, _ in left):
            if any(article and not named for named, article, _ in left):
                return held
            held.update(named[0] for named, article, _ in left if article)
            continue
        sizes: dict[int, int] = {}
        for named, _, size in left:
            if named:
                sizes[named[0]] = sizes.get(named[0], 0) + size
        most = [e for e, size in sizes.items() if 2 * size > sum(b[2] for b in found)]
        if not most:
            return held
        held.update(most)


def blocks(page: str) -> list[tuple[tuple[str, ...], int, str, int, tuple[int, ...]]]:
    """Path, number of the article around it, text, link characters and element numbers of every block of text."""
    out: list[tuple[tuple[str, ...], int, str, int, tuple[int, ...]]] = []
    names: list[tuple[int, ...]] = []
    stack: list[_Open] = [_Open("html", None, "", 0)]
    pieces: list[str] = []
    linked, links, at, number = 0, 0, 0, 0
    where = stack[0]

    def flush() -> None:
        nonlocal linked, pieces
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text and not where.boiler:
                out.append((where.path, where.article, text, linked, where.ids))
                names.append(where.named)
        pieces, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked, where
        if not text:
            return
        top = stack[-1]
        moved = top.path != where.path or top.ids != where.ids or top.article != where.article or top.named != where.named
        if moved or top.boiler != where.boiler:
            if not top.boiler or top.block:
                flush()
                where = top
        if top.boiler != where.boiler:
            return  # an inline element inside a block that is not content itself
        pieces.append(text)
        if links:
            linked += len(text)

    def close(tag: str, within: frozenset = frozenset()) -> None:
        nonlocal links
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                gone = stack[i:]
                del stack[i:]
                links -= sum(o.tag == "a" for o in gone)
                if any(o.block for o in gone):
                    flush()
                return
            if stack[i].tag in within:
                return

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                close(tag)
            else:
                flush()
                if tag == "p" or any(o.tag == tag for o in stack[1:]):
                    close(tag)
            continue
        if tag == "br":
            if pieces:
                pieces.append(" ")
            continue
        if tag in ("html", "body") and any(o.tag == tag for o in stack):
            continue
        if tag not in INLINE:
            flush()
            for same in SAME_ENDS.get(tag, ()):
                close(same, KEEPS)
            if tag not in VOID:
                close("p", KEEPS)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        number += 1
        # The path says where a block stands; inline elements are not part of it.
        stack.append(_Open(tag, _block_above(stack), m[3], number))
        if not stack[-1].block:
            above = stack[-2]
            stack[-1].boiler = above.boiler or stack[-1].boiler
            stack[-1].article, stack[-1].path, stack[-1].named = above.article, above.path, above.named
            stack[-1].ids = above.ids
        links += tag == "a"
    flush()
    held = _unnamed([(n, b[1], len(b[2])) for n, b in zip(names, out, strict=True)])
    return [b for n, b in zip(names, out, strict=True) if held.issuperset(n)]


def _block_above(stack: list[_Open]) -> _Open:
    return next(o for o in reversed(stack) if o.block)


def _smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    weight = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, weight / weight.sum(), "valid")


def main_text(page: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """The content of a page, one block a line."""
    found = blocks(page) if page else []
    if not found:
        return ""
    paths = list(dict.fromkeys(b[0] for b in found))
    place = {p: i for i, p in enumerate(paths)}
    of = np.array([place[b[0]] for b in found])
    n = np.bincount(of)
    chars = np.bincount(of, [max(len(b[2]) - 2 * b[3], 0) for b in found]) / n
    marks = np.bincount(of, [len(_MARKS.findall(b[2])) for b in found]) / n
    # Along the page, in the order of blocks; then fused, and back to paths.
    fused = _smooth(chars[of], sigma) * (PLAIN + np.log1p(_smooth(marks[of], sigma)))
    own = chars * (PLAIN + np.log1p(marks))
    score = np.sqrt(np.maximum(own, 0) * (np.bincount(of, fused) / n))
    best = score.max()
    content = score >= threshold * best if best > 0 else np.ones(len(paths), bool)
    passed = [bool(content[i]) for i in of]
    articles = {b[1] for b, ok in zip(found, passed, strict=True) if ok and b[1]}
    parents = {b[0][:-1] for b, ok in zip(found, passed, strict=True) if ok}
    # First and last content block of every element that holds one, itself or as a child.
    span: dict[int, tuple[int, int]] = {}
    for i, ok in enumerate(passed):
        if ok:
            for e in found[i][4][-2:]:
                span[e] = (span.get(e, (i,))[0], i)
    kept = []
    for i, ((path, article, text, _, ids), ok) in enumerate(zip(found, passed, strict=True)):
        between = any(span[e][0] < i < span[e][1] for e in ids if e in span)
        heads = path[-1] in HEADINGS and path[:-1] in parents
        inside = ok or (article in articles if articles else between or heads)
        if inside:
            kept.append(text)
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, page: str, text: str) -> DataFrame:
    """``pages`` with the main text of the HTML column ``page`` as ``text``, a name that no column may have."""
    if text.lower() in (c.lower() for c in pages.columns):
        raise ValueError(f"there is a column {text} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([main_text(p) for p in batch.column(page).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, text])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(text, T.StringType())]))
