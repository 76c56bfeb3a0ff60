"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public tokenizer's file; only those who encode need that package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of its own in every row.

    For a stored table: reading the same files again gives the same numbers.
    """
    return df.withColumn(name, F.monotonically_increasing_id())
