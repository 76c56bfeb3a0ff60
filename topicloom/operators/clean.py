"""Cleaning of the article table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.labels import article_id, clean_labels, fix_names
from topicloom.settings import ARTICLE_ID, BLOG_PREFIX, NAME_FIXES, NO_TEXT


def has_text(text: Column, sentinel: str = NO_TEXT) -> Column:
    """False only for the sentinel; a missing text stays in."""
    return ~text.eqNullSafe(F.lit(sentinel))


def clean_documents(
    docs: DataFrame,
    sentinel: str = NO_TEXT,
    sep: str = "|",
    mark: str = "*",
    blocked_prefix: str = BLOG_PREFIX,
    id_pattern: str = ARTICLE_ID,
    rules=NAME_FIXES,
    drop_unlabelled: bool = False,
) -> DataFrame:
    """Articles with text and id; hubs and tags as cleaned arrays, plus ``doc_id``.

    Row by row, without a shuffle. ``drop_unlabelled`` also removes articles
    left without any hub or tag.
    """
    hubs = fix_names(clean_labels(F.col("hubs"), sep, mark, blocked_prefix), rules)
    tags = clean_labels(F.col("tags"), sep, mark, blocked_prefix)
    out = (
        docs.where(has_text(F.col("text"), sentinel))
        .withColumn("doc_id", article_id(F.col("url"), id_pattern))
        .where(F.col("doc_id").isNotNull())
        .withColumns({"hubs": hubs, "tags": tags})
    )
    if drop_unlabelled:
        out = out.where((F.size("hubs") > 0) & (F.size("tags") > 0))
    return out


def clean_counts(docs: DataFrame, sentinel: str = NO_TEXT, id_pattern: str = ARTICLE_ID) -> DataFrame:
    """Loaded, removed and kept articles in one pass."""
    text_ok = has_text(F.col("text"), sentinel)
    id_ok = article_id(F.col("url"), id_pattern).isNotNull()
    return docs.agg(
        F.count(F.lit(1)).alias("loaded"),
        F.count_if(~text_ok).alias("without_text"),
        F.count_if(text_ok & ~id_ok).alias("without_id"),
        F.count_if(text_ok & id_ok).alias("kept"),
    )
