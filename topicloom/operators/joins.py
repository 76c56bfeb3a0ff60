"""Lookups that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.runtime import BROADCAST_BYTES, cut, measure


def _frequent(counts: DataFrame, room: float, hot_share: float) -> DataFrame:
    """The most frequent keys: as many as ``room`` takes, and every hot one.

    Keys are graded by the power of two of their count, so one small aggregate
    tells how far down the grades the room reaches.
    """
    grade = F.floor(F.log2("n"))
    counts = counts.where(F.col("n") > 0)
    grades = (
        counts.groupBy(grade.alias("grade"))
        .agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows"))
        .collect()
    )
    total = sum(g["rows"] for g in grades)
    taken, lowest = 0, None
    for g in sorted(grades, key=lambda g: -g["grade"]):
        taken += g["keys"]
        if taken > room and 2 ** (g["grade"] + 1) <= total * hot_share:
            break
        lowest = g["grade"]
    return counts.where(grade >= F.lit(lowest)).drop("n")


def frequent_rows(
    table: DataFrame, n: Column, on: str = "token", limit: int = BROADCAST_BYTES, hot_share: float = 0.001
) -> DataFrame:
    """The rows of ``table`` with the greatest ``n``: as many as ``limit`` bytes take, and every hot one; written once."""
    rows, size = measure(table)
    room = limit * rows / size if size else 0
    return cut(_frequent(table.where(F.col(on).isNotNull()).withColumn("n", n), room, hot_share))


def rest_values(
    rows: DataFrame, dim: DataFrame, value: str, on: str = "token", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """``rows`` (written, with a key ``_row``) with ``_got``: the ``value`` of every key in its list ``_rest``.

    Only the listed keys are exchanged with ``dim``, and what was found comes back
    as one list per row; a key that ``dim`` lacks has NULL there.
    """
    keys = rows.select("_row", F.posexplode("_rest").alias("_at", on))
    found = lookup_join(keys, dim.select(on, value), on, limit)
    got = found.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", value))).alias("_got"))
    got = got.select("_row", F.transform("_got", lambda x: x[value]).alias("_got"))
    return rows.join(got, "_row", "left").drop("_rest")


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: str,
    limit: int = BROADCAST_BYTES,
    hot_share: float = 0.001,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Left join ``facts`` to ``dim``, whose key is unique.

    A dimension measured below ``limit`` bytes is broadcast. Of a larger one the
    rows of the most frequent keys are broadcast, as many as ``limit`` takes;
    with word-like keys these serve nearly all facts. The other facts are
    shuffled. No key among them is hot: whatever holds ``hot_share`` of the
    facts is always broadcast, which is at most ``2 / hot_share`` keys. Facts
    without a key match nothing and are not shuffled at all.

    ``counts`` (``on``, ``n``) saves the pass that counts the keys; every hot
    key has to be in it.
    """
    dim_rows, size = measure(dim)
    if size <= limit:
        return facts.join(F.broadcast(dim), on, "left")
    keyed = facts.where(F.col(on).isNotNull())
    if counts is None:
        counts = cut(keyed.groupBy(on).agg(F.count(F.lit(1)).alias("n")))
    hot = _frequent(counts.select(on, "n"), limit * dim_rows / size, hot_share)
    hot = cut(hot.join(dim, on, "left"))
    head = keyed.join(F.broadcast(hot), on, "inner")
    tail = keyed.join(F.broadcast(hot.select(on)), on, "left_anti").join(dim, on, "left")
    out = head.unionByName(tail)
    if facts.schema[on].nullable:
        none = {f.name: F.lit(None).cast(f.dataType) for f in dim.schema.fields if f.name != on}
        out = out.unionByName(facts.where(F.col(on).isNull()).withColumns(none))
    # Written, so that no later grouping builds on how the union's sides happen to be partitioned.
    return cut(out)


def unseen(rows: DataFrame, store: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key the store does not have. A NULL key is never in the store."""
    return rows.join(store.select(key), key, "left_anti")
