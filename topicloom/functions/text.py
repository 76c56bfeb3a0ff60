"""Text normalising and tokenising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.settings import PREVIEW_CHARS

# Unicode word and space classes. Java's \w and \s are ASCII, so they are
# spelled out; \x1c-\x1f and \x85 count as spaces, \p{Z} as separators.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"

# Word pairs an English tokeniser splits in the middle.
CONTRACTIONS = {
    "cannot": "can not",
    "gimme": "gim me",
    "gonna": "gon na",
    "gotta": "got ta",
    "lemme": "lem me",
    "wanna": "wan na",
}


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any script."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def _split_contractions(c: Column, rules: dict[str, str] | None) -> Column:
    for whole, parts in (rules or {}).items():
        c = F.regexp_replace(c, rf"(?<![{WORD}]){whole}(?![{WORD}])", parts)
    return c


def tokenize(c: Column, contractions: dict[str, str] | None = None) -> Column:
    """Lower-case words of a text: punctuation removed, split on whitespace."""
    bare = F.regexp_replace(F.lower(c), f"[^{WORD}{SPACE}]", "")
    words = F.split(_split_contractions(bare, contractions), f"[{SPACE}]+")
    return F.filter(words, lambda w: w != "")


def normalize(c: Column, contractions: dict[str, str] | None = None) -> Column:
    """The text as its tokens joined by single spaces."""
    return F.array_join(tokenize(c, contractions), " ")


def tokenize_punct(c: Column) -> Column:
    """Lower-case tokens where every punctuation mark is a token of its own."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"([{WORD}]+|[^{WORD}{SPACE}])"), F.lit(1))


def preview(c: Column, n: int = PREVIEW_CHARS) -> Column:
    """The first ``n`` characters, marked with ``...`` when cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def sentences(c: Column) -> Column:
    """Sentences of a text: runs up to closing marks or a line end, trimmed."""
    runs = F.regexp_extract_all(c, F.lit(r"([^.!?\n]+[.!?]*)"), F.lit(1))
    return F.filter(F.transform(runs, lambda s: F.trim(s)), lambda s: s != "")
