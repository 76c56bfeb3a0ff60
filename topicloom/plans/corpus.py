"""From fetched pages to the cleaned article table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators.clean import clean_documents
from topicloom.operators.extract import extract_articles
from topicloom.operators.frontier import new_links
from topicloom.operators.ranking import drop_repeats
from topicloom.runtime import cut, small_side
from topicloom.settings import DEFAULT_LAYOUT, Layout


def collect_articles(
    links: DataFrame,
    pages: DataFrame,
    store: DataFrame,
    order: list[Column],
    layout: Layout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Articles of linked pages the store lacks, categorised by the hub that links first.

    ``links`` has ``hub``, ``url`` and the columns of ``order``.
    """
    fresh = new_links(links, store, order).select(F.col("hub").alias("_hub"), "url")
    fresh, _ = small_side(cut(fresh))
    return extract_articles(pages.join(fresh, "url"), F.col("_hub"), layout)


def build_corpus(
    pages: DataFrame, category: Column, layout: Layout = DEFAULT_LAYOUT, **rules
) -> DataFrame:
    """Every article page once, extracted and cleaned."""
    once = drop_repeats(pages.where(F.col("html").isNotNull()), "url", "page_id")
    return clean_documents(extract_articles(once, category, layout), **rules)
