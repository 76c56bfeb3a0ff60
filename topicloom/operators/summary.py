"""Document frequencies, TF-IDF embeddings and extractive summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import sentences, tokenize
from topicloom.operators.joins import frequent_rows, rest_values
from topicloom.operators.lookup import add_hashed, best_sentences, best_with_rest, hashed_sums, send
from topicloom.runtime import BROADCAST_BYTES, cut, measure


def idf_table(docs: DataFrame, tokens: Column) -> DataFrame:
    """``(token, df, idf)`` with ``idf = ln((N + 1) / (df + 1))``.

    A token is counted once per document before anything is shuffled.
    """
    n = docs.agg(F.count(F.lit(1))).scalar()
    rows = docs.select(F.explode(F.array_distinct(tokens)).alias("token"))
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return counts.withColumn("idf", F.ln((n + 1) / (F.col("df") + 1)))


def doc_embedding(
    docs: DataFrame,
    id_col: str,
    tokens: Column,
    dim: int = 64,
    idf: DataFrame | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(id, embedding)``: TF-IDF hashed into ``dim`` signed buckets, unit length.

    The bucket and sign of a token come from its MD5, so the embedding needs no
    vocabulary and documents embedded at different times are comparable. A
    document without tokens gets the zero vector; a repeated or missing id is a
    document of its own. A table of token weights below ``limit`` bytes is sent to
    the tasks and nothing is exchanged; of a larger one the most frequent tokens
    are, and only the other tokens of a document are joined.
    """
    weights = cut(idf if idf is not None else idf_table(docs, tokens)).select("token", "idf")
    # md5 is taken once per distinct token, on the lookup side
    digest = F.md5("token")
    weights = weights.select(
        "token",
        F.pmod(F.conv(F.substring(digest, 1, 6), 16, 10).cast("int"), F.lit(dim)).alias("at"),
        F.when(F.substring(digest, 7, 1) < "8", F.col("idf")).otherwise(-F.col("idf")).alias("w"),
    )
    if measure(weights)[1] <= limit:
        return hashed_sums(docs, [id_col], tokens, send(weights, "token", "at", "w"), dim, "embedding")
    sent = send(_frequent_weights(weights, F.abs("w"), limit), "token", "at", "w")
    keyed = docs.select(id_col, tokens.alias("_tokens"), F.monotonically_increasing_id().alias("_row"))
    sums = cut(hashed_sums(keyed, ["_row", id_col], F.col("_tokens"), sent, dim, "embedding", rest=True))
    found = rest_values(sums, weights.select("token", F.struct("at", "w").alias("v")), "v", limit=limit)
    return add_hashed(found, [id_col], "embedding", dim)


def _frequent_weights(weights: DataFrame, idf: Column, limit: int) -> DataFrame:
    """The rows of the tokens in the most documents, which are those with the least IDF."""
    top = weights.agg(F.max(idf)).first()[0] or 0.0
    return frequent_rows(weights, F.exp(F.lit(top) - idf), limit=limit)


def extractive_summary(
    docs: DataFrame,
    id_col: str,
    text: str,
    k: int = 3,
    idf: DataFrame | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(id, summary)``: the ``k`` sentences with the highest mean IDF, in text order.

    An IDF table below ``limit`` bytes is sent to the tasks, and sentences are
    scored and picked where the text lies. Of a larger one the most frequent tokens
    are sent, and the other tokens of a document are joined by a key of the row. A
    repeated or missing id is a document of its own.
    """
    weights = cut(idf if idf is not None else idf_table(docs, tokenize(F.col(text)))).select("token", "idf")
    split = docs.select(id_col, F.coalesce(sentences(F.col(text)), F.array().cast("array<string>")).alias("_parts"))
    if measure(weights)[1] <= limit:
        words = F.transform("_parts", lambda s: tokenize(s))
        sent = send(weights, "token", "idf")
        return _joined(best_sentences(split, [id_col, "_parts"], words, sent, k, "_at"), id_col)
    sent = send(_frequent_weights(weights, F.col("idf"), limit), "token", "idf")
    keyed = split.withColumn("_row", F.monotonically_increasing_id())
    words = F.transform("_parts", lambda s: tokenize(s))
    parts = cut(best_sentences(keyed, ["_row", id_col, "_parts"], words, sent, k, "_at", rest=True))
    found = rest_values(parts, weights, "idf", limit=limit)
    return _joined(best_with_rest(found, [id_col, "_parts"], k, "_at"), id_col)


def _joined(picked: DataFrame, id_col: str) -> DataFrame:
    chosen = F.transform("_at", lambda i: F.get("_parts", i.cast("int")))
    return picked.select(id_col, F.coalesce(F.array_join(chosen, " "), F.lit("")).alias("summary"))
