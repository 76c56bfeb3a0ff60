"""Hub and tag lists, article ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions.text import strip
from topicloom.settings import ARTICLE_ID, BLOG_PREFIX, NAME_FIXES


def clean_labels(
    c: Column, sep: str = "|", mark: str = "*", blocked_prefix: str = BLOG_PREFIX
) -> Column:
    """Label array from a joined string.

    Spaces and ``mark`` are stripped from both ends, blanks and labels that
    start with ``blocked_prefix`` (any case) are dropped; order and repeats
    stay. NULL and the empty string give an empty array.
    """
    def bare(x):
        return strip(F.btrim(strip(x), F.lit(mark)))

    def keep(x):
        return (x != "") & ~F.startswith(F.lower(x), F.lit(blocked_prefix))

    parts = F.transform(F.split(F.coalesce(c, F.lit("")), F.lit(f"\\Q{sep}\\E")), bare)
    return F.filter(parts, keep)


def article_id(url: Column, pattern: str = ARTICLE_ID) -> Column:
    """Numeric article id in a URL, NULL without one."""
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")).try_cast("bigint")


def fix_names(labels: Column, rules=NAME_FIXES) -> Column:
    """Bring spelling variants of a label together by ``(pattern, name)`` rules."""
    def fixed(x):
        for pattern, name in rules:
            x = F.regexp_replace(x, pattern, name)
        return x

    return F.transform(labels, fixed)
