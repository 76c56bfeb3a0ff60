"""Lookups of whole token arrays against a table every task holds.

For tables measured small enough to be sent to the tasks. An array column is
looked up in one vectorised Arrow call per batch: no row per token, no shuffle,
and the rows stay where they are. Of a larger table the most frequent tokens are
sent; with ``rest`` a row also lists the different tokens it has beyond these, for
``joins.rest_values`` to exchange, and a second call takes in what was found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def send(table: DataFrame, *columns: str) -> Broadcast:
    """The table's columns as Arrow arrays, held once per Python worker. For tables of a checked size."""
    arrow = table.select(*columns).toArrow().combine_chunks()
    arrays = [arrow.column(c).combine_chunks() for c in columns]
    return table.sparkSession.sparkContext.broadcast(arrays)


def _with_tokens(df: DataFrame, keep: list[str], tokens: Column) -> DataFrame:
    empty = F.array().cast("array<string>")
    return df.select(*keep, F.coalesce(tokens, empty).alias("_tokens"))


def _rest(words: pa.ListArray, at: pa.Array):
    """What a table lacks of every row's tokens: lists of the different ones and how often each is there.

    Also the position of each such token among all of the batch, and its place in the list of its row.
    """
    lacks = pc.and_(pc.is_null(at), pc.is_valid(words.values))
    where = np.flatnonzero(lacks.to_numpy(zero_copy_only=False))
    row = np.searchsorted(words.offsets.to_numpy(), where, side="right") - 1
    coded = words.values.take(pa.array(where)).dictionary_encode()
    n = max(len(coded.dictionary), 1)
    pairs, place, many = np.unique(
        row * n + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True
    )
    ends = np.searchsorted(pairs, np.arange(len(words) + 1) * n).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(ends), coded.dictionary.take(pa.array(pairs % n)))
    return tokens, pa.ListArray.from_arrays(pa.array(ends), pa.array(many)), where, place - ends[row]


_REST = [T.StructField("_rest", T.ArrayType(T.StringType()))]
_MANY = [*_REST, T.StructField("_many", T.ArrayType(T.LongType()))]


def _lists(width: int, values: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.arange(0, values.size + 1, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))


def _row_of(lists: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _schema(df: DataFrame, keep: list[str], name: str, kind: T.DataType) -> T.StructType:
    kept = df.select(*keep).schema.fields
    return T.StructType([*kept, T.StructField(name, T.ArrayType(kind))])


def look_up(
    df: DataFrame, keep: list[str], tokens: Column, table: DataFrame, name: str
) -> DataFrame:
    """``keep`` and ``name``: the ``idx`` of every token, NULL for unknown ones."""
    sent = send(table, "token", "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idx = sent.value
        for batch in batches:
            *kept, words = batch.columns
            at = pc.index_in(words.values, value_set=known.cast(words.type.value_type))
            found = pa.ListArray.from_arrays(words.offsets, idx.take(at))
            yield pa.RecordBatch.from_arrays([*kept, found], [*batch.schema.names[:-1], name])

    rows = _with_tokens(df, keep, tokens)
    return rows.mapInArrow(run, _schema(df, keep, name, T.LongType()))


def look_up_frequent(df: DataFrame, keep: list[str], tokens: Column, table: DataFrame, name: str) -> DataFrame:
    """``keep``, ``name``, ``_rest``: as ``look_up``, but of a token that ``table`` lacks ``-2`` less its place in ``_rest``.

    A NULL among the tokens is -1.
    """
    sent = send(table, "token", "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idx = sent.value
        idx = np.append(idx.to_numpy(), -1)
        for batch in batches:
            *kept, words = batch.columns
            at = pc.index_in(words.values, value_set=known.cast(words.type.value_type))
            rest, _, where, place = _rest(words, at)
            found = idx[pc.fill_null(at, len(idx) - 1).to_numpy(zero_copy_only=False)]
            found[where] = -2 - place
            made = pa.ListArray.from_arrays(words.offsets, pa.array(found))
            yield pa.RecordBatch.from_arrays([*kept, made, rest], [*batch.schema.names[:-1], name, "_rest"])

    schema = _schema(df, keep, name, T.LongType())
    return _with_tokens(df, keep, tokens).mapInArrow(run, T.StructType([*schema.fields, *_REST]))


def take_rest(codes: Column, got: Column) -> Column:
    """The codes of ``look_up_frequent`` with what was found for the rest, NULL for unknown ones."""
    return F.transform(codes, lambda i: F.when(i >= 0, i).otherwise(F.get(got, (-2 - i).cast("int"))))


def sum_weights(
    df: DataFrame, keep: list[str], tokens: Column, sent: Broadcast, start: list[float], name: str, rest: bool = False
) -> DataFrame:
    """``keep`` and ``name``: ``start`` plus the summed weight arrays ``w`` of all tokens.

    With ``rest`` also ``_rest`` and ``_many``: the other tokens and how often each is there.
    """
    width = len(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = sent.value
        matrix = weights.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        matrix = np.vstack([matrix, np.zeros(width)])  # the row of unknown tokens
        for batch in batches:
            *kept, words = batch.columns
            at = pc.index_in(words.values, value_set=known.cast(words.type.value_type))
            others = _rest(words, at)[:2] if rest else ()
            at = pc.fill_null(at, len(matrix) - 1).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            row = _row_of(words)
            sums = np.empty((n, width))
            for c in range(width):
                sums[:, c] = start[c] + np.bincount(row, weights=matrix[at, c], minlength=n)
            yield pa.RecordBatch.from_arrays([*kept, _lists(width, sums), *others], schema.names)

    rows = _with_tokens(df, keep, tokens)
    schema = _schema(df, keep, name, T.DoubleType())
    schema = T.StructType([*schema.fields, *(_MANY if rest else [])])
    return rows.mapInArrow(run, schema)


def add_weights(df: DataFrame, keep: list[str], name: str, width: int) -> DataFrame:
    """``keep`` and the sums ``name`` plus ``_many`` times the weight arrays ``_got``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, sums, many, got = batch.columns
            sums = sums.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            here = got.values.is_valid().to_numpy(zero_copy_only=False)
            w = got.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            row, times = _row_of(got)[here], many.values.to_numpy()[here]
            more = [np.bincount(row, weights=times * w[:, c], minlength=batch.num_rows) for c in range(width)]
            made = _lists(width, sums + np.stack(more, axis=1))
            yield pa.RecordBatch.from_arrays([*kept, made], [*batch.schema.names[:-3], name])

    none = F.array().cast("array<array<double>>")
    rows = df.select(*keep, name, "_many", F.coalesce("_got", none).alias("_got"))
    return rows.mapInArrow(run, _schema(df, keep, name, T.DoubleType()))


def _unit(sums: np.ndarray) -> np.ndarray:
    norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)


def hashed_sums(
    df: DataFrame, keep: list[str], tokens: Column, sent: Broadcast, dim: int, name: str, rest: bool = False
) -> DataFrame:
    """``keep`` and ``name``: the summed ``w`` of all tokens at their places ``at`` below ``dim``, unit length.

    With ``rest`` the sums as they are, ``_rest`` and ``_many``: the other tokens and how often each is there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place, weight = sent.value
        place, weight = place.to_numpy(), weight.to_numpy()
        for batch in batches:
            *kept, words = batch.columns
            at = pc.index_in(words.values, value_set=known.cast(words.type.value_type))
            n = batch.num_rows
            row = _row_of(words)
            others = _rest(words, at)[:2] if rest else ()
            found = at.is_valid().to_numpy(zero_copy_only=False)
            at = at.drop_null().to_numpy()
            sums = np.bincount(row[found] * dim + place[at], weight[at], n * dim).astype(float).reshape(n, dim)
            made = _lists(dim, sums if rest else _unit(sums))
            yield pa.RecordBatch.from_arrays([*kept, made, *others], schema.names)

    rows = _with_tokens(df, keep, tokens)
    schema = _schema(df, keep, name, T.DoubleType())
    schema = T.StructType([*schema.fields, *(_MANY if rest else [])])
    return rows.mapInArrow(run, schema)


def add_hashed(df: DataFrame, keep: list[str], name: str, dim: int) -> DataFrame:
    """``keep`` and the sums ``name`` plus ``_many`` times the ``w`` in ``_got`` at their places ``at``, unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, sums, many, got = batch.columns
            sums = sums.flatten().to_numpy(zero_copy_only=False)
            here = got.values.is_valid().to_numpy(zero_copy_only=False)
            place, weight = (
                got.values.field(c).to_numpy(zero_copy_only=False)[here] for c in ("at", "w")
            )
            cell = _row_of(got)[here] * dim + place.astype(np.int64)
            sums = sums + np.bincount(cell, many.values.to_numpy()[here] * weight, len(sums))
            made = _lists(dim, _unit(sums.reshape(-1, dim)))
            yield pa.RecordBatch.from_arrays([*kept, made], [*batch.schema.names[:-3], name])

    none = F.array().cast("array<struct<at:int,w:double>>")
    rows = df.select(*keep, name, "_many", F.coalesce("_got", none).alias("_got"))
    return rows.mapInArrow(run, _schema(df, keep, name, T.DoubleType()))


def _best(total: np.ndarray, n: np.ndarray, ends: np.ndarray, k: int) -> pa.Array:
    """Of every row the places of the ``k`` sentences with the highest mean, in order."""
    score = np.round(np.divide(total, n, out=np.full(len(n), -np.inf), where=n > 0), 6)
    made = []
    for first, last in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        part = score[first:last]
        best = np.argsort(-part, kind="stable")[:k]
        made.append(np.sort(best[np.isfinite(part[best])]).tolist())
    return pa.array(made, pa.list_(pa.int64()))


def best_sentences(
    df: DataFrame, keep: list[str], tokens: Column, sent: Broadcast, k: int, name: str, rest: bool = False
) -> DataFrame:
    """``keep`` and ``name``: the places of the ``k`` sentences with the highest mean ``w``, in order.

    ``tokens`` holds an array per sentence. Means are rounded to six digits, ties
    go by place; sentences without a known token are not chosen. With ``rest`` the
    parts that ``best_with_rest`` takes instead: sum and number of the known tokens
    of every sentence, and the sentence and the place in ``_rest`` of every other token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = sent.value
        weight = weight.to_numpy()
        for batch in batches:
            *kept, texts = batch.columns
            lists = texts.values
            words = lists.values
            at = pc.index_in(words, value_set=known.cast(words.type))
            found = at.is_valid().to_numpy(zero_copy_only=False)
            of = _row_of(lists)
            total = np.bincount(of[found], weight[at.drop_null().to_numpy()], len(lists)).astype(float)
            n = np.bincount(of[found], minlength=len(lists))
            ends = texts.offsets.to_numpy()
            if not rest:
                made = [_best(total, n, ends, k)]
            else:
                starts = lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int32)
                every = pa.ListArray.from_arrays(pa.array(starts[ends]), words)
                others, _, where, place = _rest(every, at)
                cuts = pa.array(np.searchsorted(where, every.offsets.to_numpy()).astype(np.int32))
                first = ends[:-1][np.searchsorted(every.offsets.to_numpy(), where, side="right") - 1]
                values = (texts.offsets, total), (texts.offsets, n), (cuts, of[where] - first), (cuts, place)
                made = [*(pa.ListArray.from_arrays(o, pa.array(v)) for o, v in values), others]
            yield pa.RecordBatch.from_arrays([*kept, *made], schema.names)

    empty = F.array().cast("array<array<string>>")
    rows = df.select(*keep, F.coalesce(tokens, empty).alias("_tokens"))
    schema = _schema(df, keep, name, T.LongType())
    if rest:
        kinds = {"_total": T.DoubleType(), "_n": T.LongType(), "_of": T.LongType(), "_which": T.LongType()}
        parts = [T.StructField(c, T.ArrayType(t)) for c, t in kinds.items()]
        schema = T.StructType([*schema.fields[:-1], *parts, *_REST])
    return rows.mapInArrow(run, schema)


def best_with_rest(df: DataFrame, keep: list[str], k: int, name: str) -> DataFrame:
    """``best_sentences`` from its parts: ``_got`` holds the ``w`` of the tokens in ``_rest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, total, n, of, which, got = batch.columns
            ends = total.offsets.to_numpy()
            row = _row_of(which)
            weight = got.values.to_numpy(zero_copy_only=False).astype(float)  # NULL: not a number
            weight = weight[got.offsets.to_numpy()[row] + which.values.to_numpy()]
            here = ~np.isnan(weight)
            at = (ends[row] + of.values.to_numpy())[here]
            size = len(total.values)
            total = total.values.to_numpy() + np.bincount(at, weight[here], size)
            made = _best(total, n.values.to_numpy() + np.bincount(at, minlength=size), ends, k)
            yield pa.RecordBatch.from_arrays([*kept, made], [*batch.schema.names[:-5], name])

    none = F.array().cast("array<double>")
    rows = df.select(*keep, "_total", "_n", "_of", "_which", F.coalesce("_got", none).alias("_got"))
    return rows.mapInArrow(run, _schema(df, keep, name, T.LongType()))
