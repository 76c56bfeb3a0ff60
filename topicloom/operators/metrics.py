"""Evaluation metrics as lazy aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.arrays import log_loss
from topicloom.operators.ranking import top_per_group
from topicloom.runtime import cut


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Share of rows with the right class."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def cross_entropy(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Mean cross-entropy of the logits."""
    return df.agg(F.avg(log_loss(F.col(logits), F.col(label))).alias("loss"))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Rows per (true, predicted) class."""
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def class_scores(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """True positives, false positives, false negatives and F1 per class.

    Works on the confusion counts, so the shuffle carries at most one row per
    pair of classes and map task.
    """
    cells = confusion(df, label, pred)
    right = F.col(label) == F.col(pred)
    zero = F.lit(0).cast("bigint")
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(
                    F.col(label).alias("cls"),
                    F.when(right, F.col("n")).otherwise(zero).alias("tp"),
                    zero.alias("fp"),
                    F.when(right, zero).otherwise(F.col("n")).alias("fn"),
                ),
                F.struct(
                    F.col(pred).alias("cls"),
                    zero.alias("tp"),
                    F.when(right, zero).otherwise(F.col("n")).alias("fp"),
                    zero.alias("fn"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    total = sides.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return total.withColumn("f1", _f1())


def _f1() -> Column:
    return 2.0 * F.col("tp") / (2.0 * F.col("tp") + F.col("fp") + F.col("fn"))


def macro_f1(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Mean F1 over the classes that occur as true or predicted class."""
    return class_scores(df, label, pred).agg(F.avg("f1").alias("macro_f1"))


def evaluation(
    df: DataFrame, label: str = "label", pred: str = "pred", logits: str = "logits", by: list[str] | None = None
) -> DataFrame:
    """Rows, accuracy, macro F1 and loss of a scored test set (of every ``by``), scored once.

    Everything follows from one row per (true, predicted) class with its count
    and summed loss. Rows without a true class are left out.
    """
    by = by or []
    cells = (
        df.where(F.col(label).isNotNull())
        .groupBy(*by, label, pred)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(log_loss(F.col(logits), F.col(label))).alias("loss"),
        )
    )
    right = F.col(label) == F.col(pred)
    hits = F.when(right, F.col("n")).otherwise(0)
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    as_true = F.struct(
        F.col(label).alias("cls"), hits.alias("tp"), F.col("n").alias("true"), zero.alias("pred"),
        F.col("loss").alias("loss"),
    )
    as_pred = F.struct(
        F.col(pred).alias("cls"), zero.alias("tp"), zero.alias("true"), F.col("n").alias("pred"),
        none.alias("loss"),
    )
    per_class = (
        cells.select(*by, F.explode(F.array(as_true, as_pred)).alias("s"))
        .select(*by, "s.*")
        .groupBy(*by, "cls")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "true", "pred", "loss")])
    )
    f1 = 2.0 * F.col("tp") / (F.col("true") + F.col("pred"))
    n = F.sum("true")
    return per_class.groupBy(*by).agg(
        n.alias("n"),
        F.try_divide(F.sum("tp").cast("double"), n).alias("accuracy"),
        F.avg(f1).alias("macro_f1"),
        F.try_divide(F.sum("loss"), n).alias("loss"),
    )


def multilabel_f1(truth: DataFrame, pred: DataFrame, ids: list[str], label: str = "label"):
    """Precision, recall and F1 per label over (document, label) pairs.

    Both sides are stacked and counted per pair; no join.
    """
    sides = truth.select(*ids, label, F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(
        pred.select(*ids, label, F.lit(0).alias("t"), F.lit(1).alias("p"))
    )
    pairs = sides.groupBy(*ids, label).agg(F.max("t").alias("t"), F.max("p").alias("p"))
    per_label = pairs.groupBy(label).agg(
        F.sum(F.col("t") * F.col("p")).alias("tp"),
        F.sum((1 - F.col("t")) * F.col("p")).alias("fp"),
        F.sum(F.col("t") * (1 - F.col("p"))).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per_label.select(
        label,
        "tp",
        "fp",
        "fn",
        F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0)).alias("recall"),
        _f1().alias("f1"),
    )


def micro_f1(per_label: DataFrame) -> DataFrame:
    """Micro and macro F1 of a ``multilabel_f1`` table."""
    return per_label.agg(
        F.avg("f1").alias("macro_f1"),
        F.try_divide(
            F.sum("tp") * 2.0, F.sum("tp") * 2.0 + F.sum("fp") + F.sum("fn")
        ).alias("micro_f1"),
    )


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by a space."""
    size = F.size(tokens) - F.lit(n - 1)
    starts = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def rouge_n(pairs: DataFrame, ids: list[str], candidate: str, reference: str, n: int) -> DataFrame:
    """ROUGE-N of two token arrays per row: clipped n-gram overlap.

    N-grams of both sides are stacked and counted per pair; a repeated n-gram
    is summed in the map task before the shuffle. A repeated id is a pair of its own.
    """
    def side(col, is_cand):
        return F.transform(
            ngrams(F.col(col), n), lambda g: F.struct(g.alias("gram"), F.lit(is_cand).alias("c"))
        )

    both = F.explode_outer(F.concat(side(candidate, 1), side(reference, 0))).alias("g")
    keyed = cut(pairs.select(F.monotonically_increasing_id().alias("_row"), *ids, candidate, reference))
    per_gram = (
        keyed.select("_row", *ids, both)
        .groupBy("_row", *ids, F.col("g.gram").alias("gram"))
        .agg(F.sum("g.c").alias("in_cand"), F.sum(1 - F.col("g.c")).alias("in_ref"))
    )
    real = F.col("gram").isNotNull()
    sums = per_gram.groupBy("_row", *ids).agg(
        F.sum(F.when(real, F.least("in_cand", "in_ref")).otherwise(0)).alias("overlap"),
        F.sum(F.when(real, F.col("in_cand")).otherwise(0)).alias("n_cand"),
        F.sum(F.when(real, F.col("in_ref")).otherwise(0)).alias("n_ref"),
    )
    return _rouge(sums, ids)


def _rouge(sums: DataFrame, ids: list[str]) -> DataFrame:
    hit = F.col("overlap").cast("double")
    return sums.select(
        *ids,
        F.col("overlap").cast("bigint").alias("overlap"),
        F.coalesce(F.try_divide(hit, F.col("n_cand")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(hit, F.col("n_ref")), F.lit(0.0)).alias("recall"),
        F.coalesce(
            F.try_divide(2.0 * hit, F.col("n_cand") + F.col("n_ref")), F.lit(0.0)
        ).alias("f1"),
    )


def _lcs_udf():
    """Longest common subsequence of two token arrays, Arrow batch by batch.

    One bit per reference token; every candidate token updates all of them in
    a few integer operations.
    """
    def lcs(a, b) -> int:
        places: dict = {}
        for i, token in enumerate(b):
            places[token] = places.get(token, 0) | (1 << i)
        full = (1 << len(b)) - 1
        row = full
        for token in a:
            hit = row & places.get(token, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(b) - bin(row).count("1")

    def batches(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in it:
            yield pd.Series([lcs(a, b) for a, b in zip(left, right)], dtype="int64")

    return F.pandas_udf(batches, "bigint")


def rouge_l(pairs: DataFrame, ids: list[str], candidate: str, reference: str) -> DataFrame:
    """ROUGE-L of two token arrays per row; row by row, no shuffle."""
    sums = pairs.select(
        *ids,
        _lcs_udf()(F.col(candidate), F.col(reference)).alias("overlap"),
        F.size(candidate).alias("n_cand"),
        F.size(reference).alias("n_ref"),
    )
    return _rouge(sums, ids)


def v_measure(df: DataFrame, label: str, cluster: str, beta: float = 1.0) -> DataFrame:
    """Homogeneity, completeness and V-measure.

    All entropies follow from sums of ``n ln n`` over the contingency cells and
    their margins, which one ``grouping sets`` aggregation gives.
    """
    cells = df.groupBy(label, cluster).agg(F.count(F.lit(1)).alias("n"))
    sums = (
        cells.groupingSets(
            [[F.col(label), F.col(cluster)], [F.col(label)], [F.col(cluster)]], label, cluster
        )
        .agg(F.sum("n").alias("m"), F.grouping_id().alias("g"))
        .groupBy()
        .agg(
            *[
                F.sum(F.when(F.col("g") == g, F.col("m") * F.ln("m"))).alias(name)
                for g, name in ((0, "s_ck"), (1, "s_c"), (2, "s_k"))
            ],
            F.sum(F.when(F.col("g") == 0, F.col("m"))).alias("n"),
        )
    )
    n = F.col("n")
    h_c, h_k = F.ln(n) - F.col("s_c") / n, F.ln(n) - F.col("s_k") / n
    h_c_k, h_k_c = (F.col("s_k") - F.col("s_ck")) / n, (F.col("s_c") - F.col("s_ck")) / n
    tiny = F.lit(1e-12)
    scores = sums.select(
        F.when(h_c < tiny, F.lit(1.0)).otherwise(1 - h_c_k / h_c).alias("homogeneity"),
        F.when(h_k < tiny, F.lit(1.0)).otherwise(1 - h_k_c / h_k).alias("completeness"),
    )
    h, c = F.col("homogeneity"), F.col("completeness")
    v = F.when(h * beta + c < tiny, F.lit(0.0)).otherwise((1 + beta) * h * c / (beta * h + c))
    return scores.withColumn("v_measure", v)


def precision_recall_at_k(
    ranked: DataFrame, relevant: DataFrame, k: int, query: str = "query_id"
) -> DataFrame:
    """Mean precision and recall of the first ``k`` results.

    ``ranked`` has one row per result with ``rank`` from 1 and a boolean
    ``hit``; ``relevant`` one row per query with ``n_relevant``.
    """
    hits = ranked.where(F.col("rank") <= k).groupBy(query).agg(F.count_if("hit").alias("hits"))
    per_query = relevant.join(hits, query, "left").select(
        F.coalesce("hits", F.lit(0)).alias("hits"), "n_relevant"
    )
    return per_query.agg(
        F.avg(F.col("hits") / F.lit(k)).alias("precision_at_k"),
        F.avg(F.try_divide(F.col("hits").cast("double"), F.col("n_relevant"))).alias("recall_at_k"),
        F.count(F.lit(1)).alias("n_queries"),
    )


def hits_by_pairs(ranked: DataFrame, pairs: DataFrame, query: str, item: str) -> DataFrame:
    """Mark results that are among the given relevant (query, item) pairs."""
    marked = pairs.select(query, item).distinct().withColumn("_hit", F.lit(True))
    return ranked.join(marked, [query, item], "left").withColumn(
        "hit", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def epoch_metrics(runs: DataFrame, epoch: str, values: list[str]) -> DataFrame:
    """Mean of every logged value per epoch."""
    return runs.groupBy(epoch).agg(
        *[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("steps")
    )


def best_runs(runs: DataFrame, metric: str, k: int, tie: str) -> DataFrame:
    """The ``k`` runs with the smallest metric."""
    return runs.orderBy(F.col(metric).asc_nulls_last(), F.col(tie)).limit(k)


def ranked_results(found: DataFrame, query: str, score: str, item: str, k: int) -> DataFrame:
    """The ``k`` best results per query, numbered from 1."""
    return top_per_group(found, [query], [F.col(score).desc(), F.col(item)], k)
