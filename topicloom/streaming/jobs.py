"""Ingest, clean and score pages as they arrive.

The batch operators are used as they are. A job's checkpoint folder holds its
progress, so it resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from topicloom.operators.classify import TokenBayes, score_documents
from topicloom.operators.clean import clean_documents
from topicloom.operators.extract import extract_articles, extract_errors, fetched
from topicloom.operators.joins import unseen
from topicloom.operators.ranking import first_per_key
from topicloom.runtime import cut, small_side
from topicloom.settings import DEFAULT_LAYOUT, Layout
from topicloom.sources.tables import ARTICLES, PAGES
from topicloom.streaming.seen import FIRST, SeenKeys


def file_stream(
    spark: SparkSession, path: str, schema: StructType = PAGES, files_per_batch: int = 1000
) -> DataFrame:
    """Rows of a Parquet table, or of a folder new Parquet files are dropped in.

    The last letter is a glob, since the stream source takes a plain path for a
    folder and would refuse a table that is one file.
    """
    path = path.rstrip("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def unseen_in(batch: DataFrame, store: str, key: str, order: list[Column]) -> DataFrame:
    """The rows whose key the store lacks, one per key, the first in ``order``.

    The store is only asked for the keys of this batch. They are broadcast
    while they are few, so the store's key column is read but not shuffled.
    """
    keys, _ = small_side(cut(batch.select(key).distinct()))
    known = batch.sparkSession.read.parquet(store).select(key).join(keys, key, "left_semi")
    return unseen(first_per_key(batch, key, order), known.distinct(), key)


def _ensure(spark: SparkSession, path: str, schema: StructType) -> None:
    """An empty table at ``path`` if there is none yet."""
    try:
        spark.read.schema(schema).parquet(path)
    except AnalysisException:
        spark.createDataFrame([], schema).write.mode("append").parquet(path)


def ingest(
    pages: DataFrame,
    store: str,
    checkpoint: str,
    category: Column,
    layout: Layout = DEFAULT_LAYOUT,
    errors: str | None = None,
    seen: str | None = None,
    **sizes: int,
) -> StreamingQuery:
    """Append the articles of arriving pages that are not stored.

    Only new pages are extracted. Their URLs are kept at ``seen`` (beside the
    store by default; ``sizes`` are those of ``SeenKeys.open``), which a batch
    asks without reading the store; a store that is older than its ``seen`` is
    read once. Only a batch that is repeated after a failure looks into the store
    itself, for what it may have left there, so nothing is added twice. With
    ``errors``, pages that did not arrive or lack a field are logged there, one
    folder per batch, and the job goes on.
    """
    spark = pages.sparkSession
    _ensure(spark, store, ARTICLES)
    known = SeenKeys.open(spark, seen or store.rstrip("/") + ".seen", **sizes)
    if known.is_new():
        known.add(spark.read.parquet(store).select(F.col("url").alias("key")), FIRST)

    def take(batch: DataFrame, batch_id: int) -> None:
        if errors:
            failed = extract_errors(batch, layout)
            failed.write.mode("overwrite").parquet(f"{errors}/batch={batch_id}")
        again = known.begin(batch_id)
        rows = fetched(batch)
        old, _ = small_side(known.known(rows.select(F.col("url").alias("key")), batch_id))
        fresh = rows.join(old.withColumnRenamed("key", "url"), "url", "left_anti")
        urls = cut(fresh.select(F.col("url").alias("key")).distinct())
        order = [F.col("page_id")]
        fresh = unseen_in(fresh, store, "url", order) if again else first_per_key(fresh, "url", order)
        extract_articles(fresh, category, layout).write.mode("append").parquet(store)
        known.add(urls, batch_id)

    return (
        pages.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def clean_stream(
    pages: DataFrame, category: Column, layout: Layout = DEFAULT_LAYOUT, **rules
) -> DataFrame:
    """Cleaned articles of a page stream; stateless."""
    return clean_documents(extract_articles(pages, category, layout), **rules)


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stateless stream to Parquet, every row once."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_stream(
    docs: DataFrame, ids: list[str], model: TokenBayes, path: str, checkpoint: str, keep: tuple = ()
) -> StreamingQuery:
    """Score arriving texts; each micro-batch has its own folder, so a repeat replaces it.

    The model is measured and sent to the tasks once, with the first batch.
    """
    def take(batch: DataFrame, batch_id: int) -> None:
        score_documents(batch, ids, model, keep=keep).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )

    return (
        docs.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
