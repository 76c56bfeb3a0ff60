"""Fields of an HTML page as column expressions."""

from __future__ import annotations

import html.entities
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions.arrays import let
from topicloom.settings import Selector

# What never closes runs to the end, which also keeps the search linear.
_HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<(script|style|template)\b[^>]*>.*?(?:</\1\s*>|\z)"
    r"|<(rt|rp)\b[^>]*>[^<]*(?:</\2\s*>)?"
)


# The rest of a tag: a quoted value may hold the sign that else ends it.
_TAG_END = r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>"


def _attr_test(sel: Selector) -> str:
    if sel.attr is None:
        return ""
    value = re.escape(sel.value)
    inner = value if sel.exact else rf"(?:[^\"'>]*\s)?{value}(?:\s[^\"'>]*)?"
    return rf"(?=[^>]*\s(?i:{sel.attr})\s*=\s*[\"']?{inner}[\"'\s>])"


def open_tag(sel: Selector) -> str:
    """Pattern of the opening tag of the elements ``sel`` names."""
    return rf"<(?i:{sel.tag})(?=[\s>/]){_attr_test(sel)}{_TAG_END}"


def visible(page: Column) -> Column:
    """The page without comments, scripts and other text no reader sees."""
    return F.regexp_replace(page, _HIDDEN, "")


def _entity_map() -> Column:
    """Named characters as a map literal: one constant the optimizer folds."""
    pairs = [*html.entities.name2codepoint.items(), ("apos", ord("'"))]
    text = "\n".join(f"{name} {chr(code)}" for name, code in pairs)
    return F.str_to_map(F.lit(text), F.lit("\n"), F.lit(" "))


_REFERENCE = r"^(#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _numeric(ref: Column) -> Column:
    """Character of a numeric reference, NULL for a code that is none."""
    code = F.when(
        F.lower(F.substring(ref, 1, 2)) == "#x", F.conv(F.substring(ref, F.lit(3), F.length(ref)), 16, 10)
    ).otherwise(F.substring(ref, F.lit(2), F.length(ref)))

    def char(n):
        valid = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    return let(code.try_cast("int"), char)


def _decode_piece(piece: Column, names: Column) -> Column:
    """Text after an ampersand with its reference, if it has one, decoded."""
    def decoded(ref):
        char = F.when(F.startswith(ref, F.lit("#")), _numeric(ref)).when(
            ref != "", F.try_element_at(names, ref)
        )
        rest = F.substring(piece, F.length(ref) + F.lit(2), F.length(piece))
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), piece))

    return let(F.regexp_extract(piece, _REFERENCE, 1), decoded)


def decode_entities(c: Column) -> Column:
    """Named and numeric character references as characters, each decoded once."""
    names = _entity_map()

    def rebuilt(pieces):
        rest = F.slice(pieces, F.lit(2), F.size(pieces))
        return F.concat(
            F.get(pieces, F.lit(0)),
            F.array_join(F.transform(rest, lambda p: _decode_piece(p, names)), ""),
        )

    return let(
        c, lambda x: F.when(F.contains(x, F.lit("&")), let(F.split(x, "&"), rebuilt)).otherwise(x)
    )


def strip_tags(c: Column) -> Column:
    """Text of a fragment: tags dropped without a gap, entities decoded."""
    return decode_entities(F.regexp_replace(c, f"<{_TAG_END}", ""))


def _until_close(tail: Column, tag: str) -> Column:
    """The part of ``tail`` before the end tag of the element that was opened.

    Inner elements with the same tag are stepped over by counting depth; an
    element that never closes runs to the end of the page.
    """
    pieces = F.split(tail, rf"(?i)(?=<{tag}[\s>/])|(?=</{tag}\s*>)")

    def scan(ps):
        def step(acc, piece):
            depth = (
                acc["depth"]
                + F.when(F.rlike(piece, F.lit(rf"(?i)^<{tag}[\s>/]")), 1)
                .when(F.rlike(piece, F.lit(rf"(?i)^</{tag}\s*>")), -1)
                .otherwise(0)
            )
            return F.struct(
                depth.alias("depth"),
                (acc["i"] + 1).alias("i"),
                F.when((acc["cut"] < 0) & (depth == 0), acc["i"])
                .otherwise(acc["cut"])
                .alias("cut"),
            )

        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("i"), F.lit(-1).alias("cut"))
        end = F.aggregate(
            ps, start, step, lambda a: F.when(a["cut"] < 0, a["i"]).otherwise(a["cut"])
        )
        return F.array_join(F.slice(ps, F.lit(1), end), "")

    return let(pieces, scan)


def element_html(page: Column, sel: Selector) -> Column:
    """Inner HTML of the first element ``sel`` names, NULL if there is none."""
    return let(
        F.split(page, open_tag(sel), 2),
        lambda parts: F.when(F.size(parts) > 1, _until_close(F.get(parts, F.lit(1)), sel.tag)),
    )


def element_text(page: Column, sel: Selector) -> Column:
    """Text of the first element ``sel`` names, NULL if there is none."""
    return strip_tags(element_html(page, sel))


# --- all elements of a page, as intervals of its pieces -----------------------
#
# A piece is a tag and the text up to the next tag. An element is the interval
# ``[open, close)`` of the pieces from its opening tag to before its end tag, so
# its text is theirs, and one element holds another if its interval does.

# Fixed values of HTML: elements without content, elements that the next of their
# kind ends, and those across which it does not.
_VOID = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
)
_ENDED_BY_NEXT = ("p", "li", "dt", "dd", "option", "tr", "td", "th")
_SCOPES = (
    "article", "aside", "blockquote", "body", "button", "div", "dl", "footer", "form", "header",
    "main", "nav", "ol", "section", "select", "table", "ul",
)
_TAG = rf"</?[A-Za-z]{_TAG_END}"
_PIECE = rf"(?s){_TAG}(?:[^<]++|<(?!/?[A-Za-z]{_TAG_END}))*+"

_OPEN = "struct<name:string,open:int,hits:int>"
_SPAN = "struct<open:int,close:int,depth:int,hits:int>"
# Tags that are gone through together: what they gather is copied at every tag, the rest once a chunk.
_CHUNK = 128


def pieces(page: Column) -> Column:
    """The tags of a page in order, each with the text after it."""
    return F.regexp_extract_all(page, F.lit(_PIECE), F.lit(0))


def _tag_events(parts: Column, sels: tuple[Selector, ...]) -> Column:
    """Per piece: its element's name, whether it closes or stands alone, and the selectors it meets as bits."""
    def event(piece):
        hits = F.lit(0)
        for i, sel in enumerate(sels):
            hits = hits + F.when(F.rlike(piece, F.lit("^" + open_tag(sel))), 1 << i).otherwise(0)
        name = F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][^\s/>]*)", 1))
        return F.struct(
            name.alias("name"),
            F.startswith(piece, F.lit("</")).alias("closes"),
            (name.isin(*_VOID) | F.rlike(piece, F.lit(r"^<[^>]*/>"))).alias("alone"),
            hits.cast("int").alias("hits"),
        )

    return F.transform(parts, event)


def _ended(state: Column, many: Column) -> Column:
    """Spans of the elements among the ``many`` innermost that a selector names; they end here."""
    gone = F.transform(
        F.slice(state["stack"], F.lit(1), many),
        lambda s, k: F.struct(
            s["open"].alias("open"), state["i"].alias("close"),
            (F.size(state["stack"]) - k - 1).cast("int").alias("depth"), s["hits"].alias("hits"),
        ),
    )
    return F.filter(gone, lambda s: s["hits"] > 0)


def element_spans(parts: Column, sels: tuple[Selector, ...]) -> Column:
    """``open, close, depth, hits`` of every element that one of ``sels`` names, in page order.

    One pass over the tags with the open elements on a stack, innermost first.
    An end tag ends the nearest open element of its name and all inside it, or
    nothing if there is none; what never ends runs to the end of the page.
    ``depth`` counts the open elements around it, ``hits`` has a bit per selector.
    """
    def step(state, e):
        names = F.transform(state["stack"], lambda s: s["name"])
        at = F.array_position(names, e["name"]).cast("int")
        fence = F.array_position(F.transform(names, lambda n: n.isin(*_SCOPES)), True).cast("int")
        next_ = e["name"].isin(*_ENDED_BY_NEXT) & ((fence == 0) | (at < fence))
        many = F.when(e["closes"] | next_, at).otherwise(0)

        def moved(ended):
            spans = _ended(state, ended)
            itself = F.struct(
                state["i"].alias("open"), state["i"].alias("close"),
                F.size(state["stack"]).alias("depth"), e["hits"].alias("hits"),
            )
            spans = F.when(e["alone"] & (e["hits"] > 0), F.concat(spans, F.array(itself))).otherwise(spans)
            rest = F.slice(state["stack"], ended + 1, F.size(state["stack"]))
            opened = F.struct(e["name"].alias("name"), state["i"].alias("open"), e["hits"].alias("hits"))
            stack = F.when(e["closes"] | e["alone"], rest).otherwise(F.concat(F.array(opened), rest))
            return F.struct(
                (state["i"] + 1).alias("i"),
                stack.alias("stack"),
                F.concat(state["done"], spans).alias("done"),
            )

        return let(many, moved)

    none = F.array().cast(f"array<{_SPAN}>")

    def of_chunk(events, state, k):
        start = F.struct(state["i"].alias("i"), state["stack"].alias("stack"), none.alias("done"))
        return F.aggregate(F.slice(events, k * _CHUNK + 1, F.lit(_CHUNK)), start, step)

    def add(state, chunk):
        return F.struct(
            chunk["i"].alias("i"), chunk["stack"].alias("stack"),
            F.concat(state["done"], chunk["done"]).alias("done"),
        )

    def all_spans(events):
        start = F.struct(
            F.lit(0).alias("i"), F.array().cast(f"array<{_OPEN}>").alias("stack"), none.alias("done")
        )
        return F.aggregate(
            F.sequence(F.lit(0), F.floor(F.size(events) / _CHUNK).cast("int")),
            start,
            lambda state, k: let(of_chunk(events, state, k), lambda chunk: add(state, chunk)),
            lambda s: F.array_sort(F.concat(s["done"], _ended(s, F.size(s["stack"])))),
        )

    return let(_tag_events(parts, sels), all_spans)


def _chosen(spans: Column, count: int) -> Column:
    """The spans of the last selector that lie in one of the selector before it, and so on outwards."""
    def named(i):
        return F.filter(spans, lambda s: s["hits"].bitwiseAND(1 << i) > 0)

    def inside(kept, i):
        return let(
            kept,
            lambda outer: F.filter(
                named(i),
                lambda s: F.exists(outer, lambda o: (o["open"] < s["open"]) & (s["close"] <= o["close"])),
            ),
        )

    kept = named(0)
    for i in range(1, count):
        kept = inside(kept, i)
    return kept


def element_texts(page: Column, *sels: Selector) -> Column:
    """Texts of all elements the last selector names, in page order, each with all that is inside it.

    Of several selectors every one but the last names an element around it.
    A page without such an element has none, a NULL page NULL.
    """
    def found(parts):
        texts = F.transform(parts, lambda p: F.regexp_replace(p, f"^{_TAG}", ""))

        def of(ts):
            chosen = let(element_spans(parts, sels), lambda spans: _chosen(spans, len(sels)))
            return F.transform(
                chosen,
                lambda s: decode_entities(
                    F.array_join(F.slice(ts, s["open"] + 1, s["close"] - s["open"]), "")
                ),
            )

        return let(texts, of)

    every = let(pieces(page), found)
    last = open_tag(sels[-1])
    if len(sels) == 1 and sels[0].tag.isalnum():
        # Where each is ended by the very next tag, its text is what lies between.
        alone = rf"{last}(?<!/>)([^<]*)</(?i:{sels[0].tag})\s*>"
        every = let(
            F.regexp_extract_all(page, F.lit(alone), F.lit(1)),
            lambda ts: F.when(
                F.size(ts) == F.regexp_count(page, F.lit(last)), F.transform(ts, decode_entities)
            ).otherwise(let(pieces(page), found)),
        )
    none = F.array().cast("array<string>")
    return F.when(F.rlike(page, F.lit(last)), every).otherwise(F.when(page.isNotNull(), none))


def _attr_of(tag_text: Column, attr: str) -> Column:
    pattern = rf"(?is)\s{attr}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    def value(tag):
        groups = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
        return F.when(F.rlike(tag, F.lit(pattern)), decode_entities(groups))

    return let(tag_text, value)


def attr_value(page: Column, sel: Selector, attr: str) -> Column:
    """An attribute of the first element ``sel`` names, NULL if either is missing."""
    return _attr_of(F.regexp_substr(page, F.lit(open_tag(sel))), attr)


def attr_values(page: Column, sel: Selector, attr: str) -> Column:
    """An attribute of all elements ``sel`` names; elements without it are left out."""
    tags = F.regexp_extract_all(page, F.lit(open_tag(sel)), F.lit(0))
    return F.filter(F.transform(tags, lambda t: _attr_of(t, attr)), lambda v: v.isNotNull())
