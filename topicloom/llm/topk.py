"""Exact top-k inner products with norm buckets.

Vectors are grouped by length into buckets of bounded size, a length that many
vectors share into several. Queries meet the longest vectors first, which gives
each a score to beat. By that score and a bucket's greatest length a query knows
the least cosine that can still help there: above one it skips the bucket; where
it is high, vectors are pruned by the query's strongest coordinates, whose values
that cosine confines to an interval; else by their length. What is left is
verified with the full product. Queries and buckets meet in blocks, each pair in
a task of its own and only if it can hold an answer.

Components are rounded to whole numbers first, so scores are exact.

Defined results: vectors that are NULL or hold NULL or non-finite components
take no part; vectors meet only others of their dimension; repeated ids are rows
of their own and each may answer the other; equal scores go by id, rows without
an id last; an empty table gives an empty table. Scores beyond 64 bits stop at
the greatest number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import ref
from topicloom.runtime import cut

BUCKET_ROWS = 4096
QUERY_ROWS = 1024
#: Local cosine from which coordinates prune better than lengths, and how many are looked at.
COORDINATE_FROM = 0.6
COORDINATES = 3
_SLACK = 1e-9
_EXACT = float(1 << 53)


def _prepared(rows: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """``row, id, dim, norm, v``: vectors of whole numbers, packed. Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if v is None or any(x is None for x in v):
                    continue
                whole = np.floor(scale * np.array(v, np.float64))
                if np.isfinite(whole).all():
                    out.append((row, i, len(whole), float(np.sqrt(whole @ whole)), whole.tobytes()))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["row", "id", "dim", "norm", "v"]
            )

    chosen = rows.select(F.monotonically_increasing_id().alias("row"), ref(vec_id).cast("long"), ref(vector))
    return cut(chosen.mapInArrow(run, "row long, id long, dim int, norm double, v binary"))


def _bucketed(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``bucket``: one range of lengths, longest 0, and a part of it."""
    dims = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    level = F.lit(0)
    for dim, n in dims.items():
        parts = n // BUCKET_ROWS
        if parts:
            shares = [i / (parts + 1) for i in range(1, parts + 1)]
            bounds = vectors.where(F.col("dim") == dim).approxQuantile("norm", shares, 0.1 / (parts + 1))
            above = F.array_size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b > F.col("norm")))
            level = F.when(F.col("dim") == dim, above).otherwise(level)
    rows = vectors.withColumn("level", level)
    sizes = rows.groupBy("dim", "level").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).cast("int").alias("parts"))
    rows = rows.join(sizes, ["dim", "level"])
    return rows.withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int")).drop("parts")


def _matrix(packed: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), dim)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact products as 64-bit integers, queries down and vectors across."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    if np.abs(q).max() * np.abs(v).max() * q.shape[1] < _EXACT:
        return (q @ v.T).astype(np.int64)
    big = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in v], object).T
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _survivors(q: np.ndarray, norm: float, least: float, v: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Places in a bucket (longest first) that may reach ``least`` with one query."""
    if least <= 0 or norm == 0:
        return np.arange(len(v)) if least <= 0 else np.zeros(0, np.int64)
    by_length = int(np.searchsorted(-norms, -least / norm * (1 - _SLACK), "right"))
    cosine = least / (norm * norms[0]) * (1 - _SLACK) if by_length else 2.0
    if cosine > 1 or not by_length:
        return np.zeros(0, np.int64)
    if cosine < COORDINATE_FROM:
        return np.arange(by_length)
    unit = q / norm
    keep = np.ones(by_length, bool)
    for f in np.argsort(-np.abs(unit))[:COORDINATES]:
        room = np.sqrt((1 - cosine**2) * max(1 - unit[f] ** 2, 0.0)) + _SLACK
        of = v[:by_length, f] / norms[:by_length]
        # A vector's own cosine is at least the bucket's, so the interval only narrows.
        keep &= (of >= unit[f] * cosine - room) if unit[f] > 0 else (of <= unit[f] * cosine + room)
    return np.flatnonzero(keep)


def _search(q: pa.Table, v: pa.Table, k: int) -> pa.Table:
    """The best ``k`` of a bucket for every query of a block that can still gain."""
    names = ["query", "query_id", "id", "score"]
    asked, held, scores = [], [], []
    if len(q) and len(v):
        dim = q.column("dim")[0].as_py()
        order = np.argsort(-v.column("norm").to_numpy(), kind="stable")
        norms = v.column("norm").to_numpy()[order]
        vm = _matrix(v.column("v").to_pylist(), dim)[order]
        rows = v.column("row").to_numpy()[order]
        # For ties only; a row without an id comes last.
        ids = pc.fill_null(v.column("id"), (1 << 63) - 1).to_numpy()[order]
        qm = _matrix(q.column("v").to_pylist(), dim)
        least = q.column("least").to_numpy()
        whole = _products(qm, vm) if np.isneginf(least).all() else None
        for i, row in enumerate(q.column("row").to_pylist()):
            at = np.arange(len(vm))
            if whole is None:
                at = _survivors(qm[i], float(q.column("norm")[i].as_py()), float(least[i]), vm, norms)
            at = at[rows[at] != row]
            score = whole[i, at] if whole is not None else _products(qm[i : i + 1], vm[at])[0]
            hit = score >= least[i]
            at, score = at[hit], score[hit]
            top = np.lexsort((ids[at], -score))[:k]
            asked.append(np.full(len(top), i))
            held.append(order[at[top]])
            scores.append(score[top])
    asked, held, scores = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (asked, held, scores))
    asked, held = pa.array(asked, pa.int64()), pa.array(held, pa.int64())
    found = [q.column("row").take(asked), q.column("id").take(asked), v.column("id").take(held)]
    return pa.table([*found, pa.array(scores, pa.int64())], names)


def top_k(rows: DataFrame, vec_id: str, vector: str, is_query: Column, k: int, scale: float = 64.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of each row that ``is_query`` holds for.

    ``is_query`` speaks of the id as ``id``.
    """
    vectors = cut(_bucketed(_prepared(rows, vec_id, vector, scale)))
    queries = vectors.where(is_query).select("row", "id", "dim", "norm", "v")
    blocks = queries.count() // QUERY_ROWS + 1
    queries = cut(queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")))
    buckets = vectors.groupBy("dim", "level", "part").agg(F.max("norm").alias("longest"))
    ids = ("dim", "block", "level", "part")

    def met(asking: DataFrame, where: Column) -> DataFrame:
        able = asking.join(F.broadcast(buckets), "dim").where(where)
        needed = F.col("least") <= F.col("norm") * F.col("longest") * (1 + _SLACK)
        able = able.where(needed).drop("longest")
        cells = able.select(*ids).distinct().toDF(*[f"its_{c}" for c in ids])
        same = [F.col(c) == F.col(f"its_{c}") for c in ("dim", "level", "part")]
        side = vectors.join(cells, same).drop("dim", "level", "part")
        held = able.groupBy(*ids).cogroup(side.groupBy(*[f"its_{c}" for c in ids]))
        return held.applyInArrow(
            lambda q, v: _search(q, v, k), "query long, query_id long, id long, score long"
        )

    asking = queries.withColumn("least", F.lit(float("-inf")))
    first = cut(met(asking, F.col("level") == 0))
    kth = first.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"))))
    kth = kth.where(F.col("at") == k).select(F.col("query").alias("row"), F.col("score").cast("double").alias("least"))
    asking = queries.join(kth, "row", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    found = first.unionByName(met(asking, F.col("level") > 0))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
