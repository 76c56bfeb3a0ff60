"""Mixing sources to target weights, from DataFrame functions only.

Every row gets a hash-random key. Rows are range-sorted by it within their
source, in ranges of a few thousand rows, so a source with a third of all rows
is many ranges; each range is summed on its own and a prefix sum over the small
table of range totals places it in its source. A source is then taken in whole
epochs and, in the last one, up to exactly its budget: the row at the cut is
taken in part.

Defined results: rows with a NULL source are one source, numbered last; a row
without size is never taken; repeated rows are rows of their own; equal keys
go by id and then by size; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import fresh, ref
from topicloom.llm.words import GAP, WORD
from topicloom.runtime import cut, small_side

RANGE_ROWS = 4096
KEY_BITS = 60


def random_key(seed: int, row_id: Column) -> Column:
    """A hash-random number below ``2**60`` that every run gives again."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(
    rows: DataFrame, source: str, size: str, weights: Sequence[int], share: tuple[int, int], epochs: int
) -> DataFrame:
    """One row per source: ``no, source, n_rows, source_size, target``.

    Sources in code point order, NULL last, weigh ``weights`` in turn and share
    ``share`` (a fraction) of all sizes. A target stops at ``epochs`` times its
    source; what it leaves is shared among the others by weight. That is a
    water level: with sources ordered by limit per weight, the first ones are
    full, and the others stand at one level per weight. The windows run over
    one row per source.
    """
    totals = rows.groupBy(ref(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(ref(size)).cast("long").alias("source_size")
    )
    named = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % n + 1).cast("int"))
    totals = totals.withColumn("no", (F.row_number().over(named) - 1).cast("long"))
    totals = totals.withColumns({"w": weight.cast("long"), "limit": epochs * F.col("source_size")})
    every = Window.partitionBy()
    filled = Window.orderBy(F.col("limit") / F.col("w"), "no")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns(
        {
            "all": F.sum("source_size").over(every),
            "full": F.coalesce(F.sum("limit").over(before), F.lit(0)),
            "left": F.sum("w").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    # The level if this source and all behind it were not full.
    up, down = share
    totals = totals.withColumns(
        {"rest": up * F.col("all") - down * F.col("full"), "under": down * F.col("left")}
    )
    is_full = F.col("rest") * F.col("w") >= F.col("limit") * F.col("under")
    per_weight = (F.col("limit") / F.col("w")).alias("per_weight")
    open_ = F.min(F.when(~is_full, F.struct(per_weight, "no", "rest", "under")))
    totals = totals.withColumn("open", open_.over(every))
    at_level = F.col("open.rest") * F.col("w") / F.col("open.under")
    target = F.when(is_full | F.col("open").isNull(), F.col("limit").cast("double")).otherwise(at_level)
    return totals.select("no", "source", "n_rows", "source_size", target.alias("target"))


def mix(
    rows: DataFrame,
    row_id: str,
    source: str,
    size: str,
    weights: Sequence[int] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    epochs: int = 2,
    seed: int = 42,
) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``taken``, the size taken of each row.

    ``rows`` has to be a written table without long columns; it is read twice.
    Its other columns may have any names but those three, which are refused.
    """
    names = rows.columns
    made = [c for c in names if c.lower() in ("source_size", "target", "taken")]
    if made:
        raise ValueError(f"there is a column {made[0]} already")
    # Under names of their own the columns cannot meet those that are made here.
    rows = rows.toDF(*[f"in_{i}" for i in range(len(names))])
    row_id, source, size = (f"in_{names.index(c)}" for c in (row_id, source, size))
    targets = cut(source_targets(rows, source, size, weights, share, epochs))
    ranges = F.greatest(F.ceil(F.col("n_rows") / RANGE_ROWS), F.lit(1)).cast("long")
    side, _ = small_side(targets.withColumn("n_ranges", ranges).withColumnRenamed("source", "_source"))
    keyed = rows.withColumn("_key", random_key(seed, ref(row_id)))
    keyed = keyed.join(side, ref(source).eqNullSafe(F.col("_source")))
    part = F.floor(F.col("_key") / F.lit(float(1 << KEY_BITS)) * F.col("n_ranges"))
    part = F.least(part, F.col("n_ranges") - 1).cast("long")
    keyed = keyed.withColumn("_range", part)
    inner = Window.partitionBy("no", "_range").orderBy("_key", ref(row_id), ref(size))
    inner = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("_before", F.sum(ref(size)).over(inner) - ref(size))
    totals = keyed.groupBy("no", "_range").agg(F.sum(ref(size)).alias("_sum"))
    along = Window.partitionBy("no").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "no", "_range", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_first")
    )
    offsets, _ = small_side(cut(offsets))
    placed = placed.join(offsets, ["no", "_range"])
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    rest = budget - whole * F.col("source_size")
    last = F.least(F.greatest(rest - F.col("_first") - F.col("_before"), F.lit(0)), ref(size))
    return placed.select(
        *[ref(c).alias(name) for c, name in zip(rows.columns, names)],
        "source_size",
        "target",
        (whole * ref(size) + last).cast("long").alias("taken"),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, as written."""
    pieces = F.regexp_extract_all(text, F.lit(f"{GAP}*{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def copies(rows: DataFrame, text: str, size: str, taken: str) -> DataFrame:
    """The mix itself: each row once per time it is taken whole, and once more cut to what is left."""
    s, t = ref(size), ref(taken)
    whole = F.floor(t / s).cast("int")
    again = F.array_repeat(F.lit(None).cast("long"), whole)
    part = F.when(t % s > 0, F.array(t % s)).otherwise(F.array().cast("array<bigint>"))
    p = fresh(rows, "_part")
    out = rows.where((s > 0) & (t > 0)).withColumn(p, F.explode(F.concat(again, part)))
    kept = F.when(F.col(p).isNull(), ref(text)).otherwise(first_words(ref(text), F.col(p)))
    return out.withColumn(text, kept).drop(p)
