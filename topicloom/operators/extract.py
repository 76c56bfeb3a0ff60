"""Article records from fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.html import attr_value, element_text, element_texts, visible
from topicloom.functions.text import strip
from topicloom.settings import (
    DEFAULT_LAYOUT, NO_DATE, NO_HUBS, NO_SUMMARY, NO_TAGS, NO_TEXT, NO_TITLE, Layout,
)

ARTICLE_COLUMNS = ("category", "url", "title", "text", "summary", "hubs", "tags", "date")


def fetched(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages that did arrive."""
    return pages.where(F.col(html).isNotNull())


def _fields(page: Column, layout: Layout) -> dict[str, Column]:
    """Raw fields of a page whose hidden text is gone; NULL where missing."""
    return {
        "title": F.replace(element_text(page, layout.title), F.lit("'"), F.lit("")),
        "text": element_text(page, layout.body),
        "hubs": element_texts(page, layout.hubs),
        "tags": F.nullif(attr_value(page, layout.tags, layout.tags_attr), F.lit("")),
        "date": attr_value(page, layout.date, layout.date_attr),
    }


def joined_tags(keywords: Column) -> Column:
    """Comma-separated keywords, trimmed and joined by ``|``."""
    return F.array_join(F.transform(F.split(keywords, ","), strip), "|")


def extract_articles(
    pages: DataFrame,
    category: Column,
    layout: Layout = DEFAULT_LAYOUT,
    html: str = "html",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The eight article columns for every fetched page.

    A field the page does not have gets its sentinel. Stateless, so it runs on
    a stream as well.
    """
    got = fetched(pages, html).select(
        *keep, category.alias("category"), "url", visible(F.col(html)).alias("_page")
    )
    raw = got.select(
        *keep, "category", "url", *[c.alias(n) for n, c in _fields(F.col("_page"), layout).items()]
    )
    return raw.select(
        *keep,
        "category",
        "url",
        F.coalesce("title", F.lit(NO_TITLE)).alias("title"),
        F.coalesce("text", F.lit(NO_TEXT)).alias("text"),
        F.lit(NO_SUMMARY).alias("summary"),
        F.when(F.size("hubs") > 0, F.array_join("hubs", "|")).otherwise(NO_HUBS).alias("hubs"),
        F.coalesce(joined_tags(F.col("tags")), F.lit(NO_TAGS)).alias("tags"),
        F.coalesce("date", F.lit(NO_DATE)).alias("date"),
    )


def extract_errors(pages: DataFrame, layout: Layout = DEFAULT_LAYOUT, html: str = "html") -> DataFrame:
    """``(url, error)``: pages that did not arrive or that lack a field."""
    got = pages.select("url", F.col(html).isNull().alias("lost"), visible(F.col(html)).alias("_page"))
    fields = _fields(F.col("_page"), layout)
    missing = {n: c.isNull() for n, c in fields.items() if n != "hubs"}
    missing["hubs"] = F.size(fields["hubs"]) == 0
    errors = F.when(F.col("lost"), F.array(F.lit("page not fetched"))).otherwise(
        F.array_compact(F.array(*[F.when(m, F.lit(f"no {n}")) for n, m in missing.items()]))
    )
    return got.select("url", F.explode(errors).alias("error"))
