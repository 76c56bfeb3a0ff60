"""As-of joins: for every row the last known row of its key, without a task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators.ranking import _ROW_BITS
from topicloom.runtime import cut


def asof_join(
    left: DataFrame, right: DataFrame, key: str, time: str, tie: str, values: dict[str, str], strict: bool = False
) -> DataFrame:
    """``left`` with the ``values`` (name -> new name) of the latest row of ``right`` up to its time.

    Both sides are stacked and range-sorted by key and time, so a hot key lies in
    many ranges. Within a range the last known values are carried along; only a
    range's last key can go on in the next, so one row per range tells what is
    carried over. Rows of ``right`` at the same time count as known, unless
    ``strict``; of several the one with the greatest ``tie`` is taken. Rows without
    a key or time match nothing; a row of ``left`` without a match keeps NULLs.
    """
    held = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    mine = left.select(
        F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(0 if strict else 1).alias("_side"),
        F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*left.columns).alias("_row"),
    )
    theirs = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(1 if strict else 0).alias("_side"),
        F.col(tie).alias("_tie"), held.alias("_held"),
    )
    stacked = mine.unionByName(theirs, allowMissingColumns=True)
    order = ["_key", "_time", "_side", "_tie"]
    rows = cut(stacked.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    along = Window.partitionBy("_part", "_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    known = rows.withColumn("_known", F.last("_held", ignorenulls=True).over(along))
    # Per range its last key and what is known of it there; NULL keys come first and know nothing.
    ends = rows.groupBy("_part").agg(
        F.max("_key").alias("_key"),
        F.max_by(F.when(F.col("_held").isNotNull(), F.struct("_key", "_held")),
                 F.when(F.col("_held").isNotNull(), F.col("_at"))).alias("_last"),
    )
    ends = ends.withColumn("_end", F.when(F.col("_last._key") == F.col("_key"), F.col("_last._held")))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    carried = ends.select(
        "_key", F.col("_part").alias("_from"), F.last("_end", ignorenulls=True).over(before).alias("_carried")
    )
    # One row per range: each range's first key meets what the ranges before it knew of that key.
    firsts = rows.groupBy("_part").agg(F.min("_key").alias("_key"))
    over = firsts.join(carried, "_key").where(F.col("_from") < F.col("_part"))
    over = cut(over.groupBy("_part", "_key").agg(F.max_by("_carried", "_from").alias("_carried")))
    out = known.where(F.col("_row").isNotNull()).join(F.broadcast(over), ["_part", "_key"], "left")
    got = F.when(F.col("_time").isNotNull(), F.coalesce("_known", "_carried"))
    return out.withColumn("_got", got).select(
        "_row.*", *[F.col(f"_got.v{i}").alias(new) for i, new in enumerate(values.values())]
    )
