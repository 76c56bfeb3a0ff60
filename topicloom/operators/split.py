"""Exact, reproducible splits that move no document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators.joins import lookup_join
from topicloom.operators.ranking import dense_index
from topicloom.runtime import cut, small_side
from topicloom.settings import SEED, TEST_PART, VAL_PART

# Rows are binned by the first four hex digits of their hash, so the bins of a
# class have equal expected size and their order is the order of the hashes.
_BIN_DIGITS = 4


def _hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _borders(df: DataFrame, id_col: str, by: Column, part: float, seed: int) -> DataFrame:
    """``_by, _last, _take, _many``: the last hash of the chosen part of every class.

    The chosen part of a class are its ``floor(part * size)`` rows with the
    smallest hash; ``_take`` of the ``_many`` rows with the last hash belong to it.
    Bin counts (summed in the map tasks) tell in which bin the last one lies, and
    only the hashes of that bin are counted one by one.
    """
    keys = df.select(by.alias("_by"), _hash(id_col, seed).alias("_h"))
    keys = keys.withColumn("_bin", F.substring("_h", 1, _BIN_DIGITS))
    w = Window.partitionBy("_by")

    def reached(rows: DataFrame, order: str, k: Column) -> DataFrame:
        below = F.sum("_n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_k", k).withColumn("_below", F.coalesce(below, F.lit(0)))
        rows = rows.where((F.col("_below") < F.col("_k")) & (F.col("_k") <= F.col("_below") + F.col("_n")))
        return rows.withColumn("_left", F.col("_k") - F.col("_below"))

    n = F.count(F.lit(1)).alias("_n")
    bins = reached(keys.groupBy("_by", "_bin").agg(n), "_bin", F.floor(F.sum("_n").over(w) * F.lit(part)))
    bins, _ = small_side(cut(bins.select("_by", "_bin", "_left")))
    hashes = keys.join(bins, ["_by", "_bin"]).groupBy("_by", "_left", "_h").agg(n)
    return reached(hashes.withColumnRenamed("_left", "_all"), "_h", F.col("_all")).select(
        "_by", F.col("_h").alias("_last"), F.col("_left").alias("_take"), F.col("_n").alias("_many")
    )


def _split(df: DataFrame, borders: DataFrame, id_col: str, by: Column, seed: int, names, column: str) -> DataFrame:
    """Every row compared with the border of its class; where an id is repeated there, its rows are numbered."""
    h, place = F.col("_h"), F.col("_last")
    rows = lookup_join(df.withColumns({"_by": by, "_h": _hash(id_col, seed)}), borders, "_by")
    part = F.when((h < place) | ((h == place) & (F.col("_take") == F.col("_many"))), F.lit(names[1]))
    split = rows.withColumn(column, part.otherwise(F.lit(names[0])))
    if borders.where("_take < _many").isEmpty():
        return split.select(*df.columns, column)
    tie = (h == place) & (F.col("_take") < F.col("_many"))
    tied = dense_index(rows.where(tie), ["_by", F.xxhash64(*df.columns)], "_no")
    first = tied.groupBy("_by").agg(F.min("_no").alias("_first"))
    taken = F.when(F.col("_no") - F.col("_first") < F.col("_take"), F.lit(names[1])).otherwise(F.lit(names[0]))
    tied = tied.join(F.broadcast(first), "_by").withColumn(column, taken)  # one row per class
    return split.where(~F.coalesce(tie, F.lit(False))).select(*df.columns, column).unionByName(
        tied.select(*df.columns, column)
    )


def stratified_split(
    df: DataFrame,
    id_col: str,
    by: str,
    part: float = TEST_PART,
    seed: int = SEED,
    names: tuple[str, str] = ("train", "test"),
    column: str = "part",
) -> DataFrame:
    """``df`` with its split name: ``floor(part * size)`` rows of every class.

    The same rows are chosen however the data is partitioned, but for equal rows.
    Documents are only compared with the border of their class; they are not
    shuffled while the borders can be broadcast. A missing class is a class of its
    own, a missing id an id. Rows that repeat the id at the border are told apart
    by their columns.
    """
    key = F.array(F.col(by))  # equal also where the class is NULL
    return _split(df, cut(_borders(df, id_col, key, part, seed)), id_col, key, seed, names, column)


def exact_split(
    df: DataFrame,
    id_col: str,
    part: float = VAL_PART,
    seed: int = SEED,
    names: tuple[str, str] = ("train", "val"),
    column: str = "part",
) -> DataFrame:
    """``df`` with its split name: exactly ``int(part * rows)`` rows are chosen.

    The border is one row, so it becomes a literal and the split a filter, unless
    the id there is repeated.
    """
    key = F.lit(0)
    borders = cut(_borders(df, id_col, key, part, seed))
    border = borders.first()
    if border is None:
        return df.withColumn(column, F.lit(names[0]))
    if border["_take"] < border["_many"]:
        return _split(df, borders, id_col, key, seed, names, column)
    chosen = _hash(id_col, seed) <= border["_last"]
    return df.withColumn(column, F.when(chosen, F.lit(names[1])).otherwise(F.lit(names[0])))
