"""The vocabulary as one JSON object, ``{"token": index, ...}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_vocab_json(vocab: DataFrame, path: str) -> None:
    """One member per line in index order, written by all tasks.

    The part files, put one after the other in name order, are a JSON object.
    Commas inside tokens are escaped, so a reader may split at commas.
    """
    last = vocab.agg(F.max("idx")).scalar()
    first = vocab.agg(F.min("idx")).scalar()
    member = F.to_json(F.create_map(F.col("token"), F.col("idx")))
    key = F.regexp_replace(F.regexp_extract(member, r'(?s)^\{(".*"):-?\d+\}$', 1), ",", r"\\u002c")
    line = F.concat(
        F.when(F.col("idx") == first, F.lit("{")).otherwise(F.lit("")),
        key,
        F.lit(": "),
        F.col("idx").cast("string"),
        F.when(F.col("idx") == last, F.lit("}")).otherwise(F.lit(",")),
    )
    vocab.orderBy("idx").select(line.alias("value")).write.mode("overwrite").text(path)


def read_vocab_json(spark: SparkSession, path: str) -> DataFrame:
    """``(token, idx)`` from a JSON vocabulary.

    The file is split at commas, so even an object on a single line is read by
    many tasks.
    """
    parts = spark.read.option("lineSep", ",").text(path)
    member = F.regexp_replace(F.col("value"), r"^[\s{]+|[\s},]+$", "")
    return (
        parts.select(member.alias("m"))
        .where(F.col("m") != "")
        .select(
            F.explode(
                F.from_json(F.concat(F.lit("{"), F.col("m"), F.lit("}")), "map<string,bigint>")
            ).alias("token", "idx")
        )
    )
