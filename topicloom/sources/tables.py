"""Table schemas, Parquet and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field texts that mean "missing" in an article CSV.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

ARTICLES = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("category", "url", "title", "text", "summary", "hubs", "tags", "date")
    ]
)
PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
DATASET = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("target", T.IntegerType()),
    ]
)

# Article texts hold commas, quotes and line ends; fields keep their spaces.
_CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table by name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType = ARTICLES, missing: tuple = MISSING
) -> DataFrame:
    """Rows of a CSV table with a header. No type inference, so one pass.

    A quoted field can span lines, which is why a file is not split: write many
    files (``rows_per_file``) rather than a large one.
    """
    df = spark.read.schema(schema).options(**_CSV, multiLine=True).csv(path)
    text = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    if not missing:
        return df
    return df.withColumns(
        {c: F.when(~F.col(c).isin(list(missing)), F.col(c)) for c in text}
    )


def write_csv(df: DataFrame, path: str, rows_per_file: int = 200_000, mode: str = "overwrite"):
    """CSV with a header and without an index; arrays are written as JSON text."""
    flat = df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
    flat.write.mode(mode).options(**_CSV, maxRecordsPerFile=rows_per_file).csv(path)


def write_by_category(
    df: DataFrame, path: str, column: str = "category", mode: str = "append", rows_per_file: int = 1_000_000
):
    """Parquet in one folder per category.

    Every task writes its own rows, so a large category is spread over all
    tasks and nothing is shuffled.
    """
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(column).parquet(path)
