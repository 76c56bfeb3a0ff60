"""Global numbering and first-of-group without single-task windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.runtime import BROADCAST_BYTES, cut, small_side

# monotonically_increasing_id(): partition in the upper bits, row in the lower 33.
_ROW_BITS = 33


def dense_index(df: DataFrame, order: list, name: str = "idx", start: int = 0) -> DataFrame:
    """Number the rows ``start, start + 1, ...`` in the given order.

    One range shuffle and a sort in each partition. The sorted rows are
    checkpointed, so a lost executor cannot shift the partition borders
    between counting and numbering. Only one count per partition goes through
    the driver.
    """
    rows = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS)
    sizes = rows.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    offsets, total = [], start
    for r in sizes:
        offsets.append((r["_part"], total))
        total += r["count"]
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame(offsets, "_part bigint, _first bigint"))
    local = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        rows.withColumn("_part", part)
        .join(table, "_part")
        .withColumn(name, F.col("_first") + local)
        .drop("_part", "_first", "_at")
    )


def top_per_group(df: DataFrame, keys: list, order: list[Column], k: int, name: str = "rank"):
    """The first ``k`` rows of every group.

    Spark keeps at most ``k`` rows of a group per map task before the shuffle
    (WindowGroupLimit), so a hot group never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("bigint")).where(F.col(name) <= k)


def first_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return top_per_group(df, [key], order, 1, "_rank").drop("_rank")


def drop_repeats(df: DataFrame, key: str, tie: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row per key, that with the least ``tie``; wide rows stay where they lie.

    Only the two columns are shuffled to find the repeated keys. While these can
    be broadcast, rows of other keys pass unmoved, and of the repeated ones just
    the first are exchanged, since whole rows may be repeated too. A NULL key is
    a key, a NULL ``tie`` comes first. Beyond ``limit`` bytes of repeated keys all
    rows are ranked, with the same result.
    """
    place = F.struct(F.col(tie).alias("tie"))
    groups = df.groupBy(F.col(key).alias("_key")).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = cut(groups.where("_n > 1").select("_key", F.col("_first.tie").alias("_tie")))
    repeated, fits = small_side(repeated, limit)
    if not fits:
        return first_per_key(df, key, [F.col(tie)])
    same = F.col(key).eqNullSafe(F.col("_key"))
    first = df.join(repeated, same & F.col(tie).eqNullSafe(F.col("_tie")), "left_semi")
    return df.join(repeated, same, "left_anti").unionByName(cut(first_per_key(first, key, [F.col(tie)])))
