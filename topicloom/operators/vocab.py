"""Vocabulary, encoding and label targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators.joins import frequent_rows, lookup_join, rest_values
from topicloom.operators.lookup import look_up, look_up_frequent, take_rest
from topicloom.operators.ranking import dense_index
from topicloom.runtime import BROADCAST_BYTES, cut, measure
from topicloom.settings import UNK, UNK_ID


def token_rows(docs: DataFrame, ids: list[str], tokens: Column) -> DataFrame:
    """One row per token with its position from 0."""
    return docs.select(*ids, F.posexplode(tokens).alias("pos", "token"))


def keyed_tokens(docs: DataFrame, keep: list[str], tokens: Column) -> DataFrame:
    """``keep``, ``_tokens`` and a key of its own in ``_row`` for every row, written once.

    Rows that are scattered token by token come together again on that key, so
    repeated and missing ids stay rows of their own.
    """
    key = F.monotonically_increasing_id().alias("_row")
    return cut(docs.select(*keep, tokens.alias("_tokens"), key))


def token_counts(rows: DataFrame) -> DataFrame:
    """Occurrences per token, summed in each map task before the shuffle."""
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


# Bits of a position inside a packed place; the id gets the rest of a long.
_POS_BITS = 24


def _place(id_col: str, low: int | None) -> Column:
    """Id and position as one number that orders like the pair.

    With the smallest id given it is a long, otherwise a decimal that takes any
    pair. Either way a hash aggregate can keep the minimum, which it could not
    for a struct.
    """
    if low is not None:
        return F.shiftleft(F.col(id_col) - F.lit(low), _POS_BITS) + F.col("pos")
    wide = F.col(id_col).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)")
    return wide + F.col("pos")


def _indexed(rows: DataFrame, place: Column) -> DataFrame:
    seen = rows.groupBy("token").agg(
        F.min(place).alias("_place"), F.max("pos").alias("_far"), F.count(F.lit(1)).alias("n")
    )
    return dense_index(seen, ["_place", "token"], "idx", UNK_ID + 1)


def build_vocab(docs: DataFrame, id_col: str, tokens: Column, unk: str = UNK) -> DataFrame:
    """``(token, idx, n)``: ``unk`` is 0, then tokens in first-seen order.

    First seen is by ``id_col`` (an integer), then position. Counts and first
    places are found in the map tasks already, so a token travels once per task.
    """
    rows = token_rows(docs, [id_col], tokens).where(F.col("token") != unk)
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    packs = low is not None and high - low < 1 << (63 - _POS_BITS)
    indexed = _indexed(rows, _place(id_col, low if packs else None))
    if packs and (indexed.agg(F.max("_far")).first()[0] or 0) >= 1 << _POS_BITS:
        indexed = _indexed(rows, _place(id_col, None))
    special = docs.sparkSession.range(1).select(
        F.lit(unk).alias("token"), F.lit(UNK_ID).cast("bigint").alias("idx"),
        F.lit(0).cast("bigint").alias("n"),
    )
    return special.unionByName(indexed.select("token", "idx", "n"))


def ensure_unk(vocab: DataFrame, unk: str = UNK) -> DataFrame:
    """Add ``unk`` behind the largest index if the vocabulary has none."""
    row = (
        vocab.agg(
            F.coalesce(F.max("idx"), F.lit(0)).alias("top"),
            F.coalesce(F.bool_or(F.col("token") == unk), F.lit(False)).alias("has"),
        )
        .where(~F.col("has"))
        .select(F.lit(unk).alias("token"), (F.col("top") + 1).cast("bigint").alias("idx"))
    )
    return vocab.unionByName(row, allowMissingColumns=True)


def vocab_size(vocab: DataFrame) -> DataFrame:
    """Embedding rows a model needs: one more than the vocabulary has."""
    return vocab.agg((F.count(F.lit(1)) + 1).alias("vocab_size"))


def encode(
    docs: DataFrame,
    ids: list[str],
    tokens: Column,
    vocab: DataFrame,
    unk_id: int = UNK_ID,
    limit: int = BROADCAST_BYTES,
    counted: bool = False,
) -> DataFrame:
    """``(ids, seq, n_tokens, n_unk, unk_rate)`` for every document.

    Unknown tokens become ``unk_id``. A document without tokens keeps its row
    with an empty sequence and an unknown rate of NULL.

    A vocabulary measured below ``limit`` bytes is sent to the tasks, and every
    document is encoded where it lies. Of a larger one its most frequent tokens
    are sent, and only what else a document holds is joined; ``counted`` tells that
    ``n`` was counted over these documents, which is taken for their frequency if it is there.
    """
    if measure(vocab.select("token", "idx"))[1] <= limit:
        coded = look_up(docs, ids, tokens, vocab, "_idx")
    else:
        coded = _encode_by_join(docs, ids, tokens, vocab, limit, counted)
    n = F.size("_idx").cast("bigint")
    unknown = F.size(F.filter("_idx", lambda i: i.isNull())).cast("bigint")
    return coded.select(
        *ids,
        F.transform("_idx", lambda i: F.coalesce(i, F.lit(unk_id))).alias("seq"),
        n.alias("n_tokens"),
        unknown.alias("n_unk"),
    ).withColumn("unk_rate", F.try_divide(F.col("n_unk").cast("double"), F.col("n_tokens")))


def _encode_by_join(docs, ids, tokens, vocab, limit, counted) -> DataFrame:
    """``(ids, _idx)``: the most frequent tokens by a table sent to the tasks, the rest of a row by a join.

    Only the different tokens a row has beyond the sent ones are exchanged, by the
    rows' own key, which no id has to be.
    """
    ranked = vocab
    if not counted and "n" not in vocab.columns:
        ranked = vocab.join(token_counts(docs.select(F.explode(tokens).alias("token"))), "token")
    head = frequent_rows(ranked.select("token", "idx", "n"), F.col("n"), limit=limit)
    keyed = docs.select(*ids, tokens.alias("_tokens"), F.monotonically_increasing_id().alias("_row"))
    coded = cut(look_up_frequent(keyed, ["_row", *ids], F.col("_tokens"), head, "_idx"))
    found = rest_values(coded, vocab, "idx", limit=limit)
    return found.select(*ids, take_rest(F.col("_idx"), F.col("_got")).alias("_idx"))


def label_index(df: DataFrame, col: str) -> DataFrame:
    """``(col, target)``: the distinct values numbered from 0 in their order."""
    values = df.where(F.col(col).isNotNull()).select(col).distinct()
    return dense_index(values, [col], "target", 0)


def max_label(train: DataFrame, col: str) -> Column:
    """Largest label of the training rows, as a scalar subquery."""
    return train.agg(F.max(col)).scalar()


def remap_max_label(df: DataFrame, col: str, top: Column) -> DataFrame:
    """Labels 1..k as 1..k-1, 0: the largest training label becomes 0."""
    return df.withColumn(col, F.when(F.col(col) == top, F.lit(0)).otherwise(F.col(col)))


def label_sets(df: DataFrame, ids: list[str], labels: Column) -> DataFrame:
    """Multi-label targets: sorted label indices of every row of ``df``.

    A repeated id is a row of its own. Sparse, so it does not matter how many labels there are; use
    ``functions.arrays.multi_hot`` for a zero/one array over a small set.
    """
    keyed = keyed_tokens(df, ids, F.array_distinct(labels))
    rows = keyed.select("_row", *ids, F.explode_outer("_tokens").alias("label"))
    rows = rows.withColumn("label", F.coalesce("label", F.lit("")))
    index = label_index(rows.where(F.col("label") != ""), "label")
    return (
        lookup_join(rows, index, "label")
        .groupBy("_row", *ids)
        .agg(F.array_sort(F.collect_list("target")).alias("targets"))
        .drop("_row")
    )


def class_balance(df: DataFrame, col: str) -> DataFrame:
    """Rows and share of rows per class."""
    total = df.agg(F.count(col)).scalar()
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("share", F.col("n") / total)
    )
