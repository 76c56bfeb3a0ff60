"""Choosing a naive Bayes model by leave-fold-out counts, and one model per label.

Token counts add up, so the model without a fold is all counts less those of the
fold: one pass over the texts gives the models of every fold and every smoothing
value, a second one scores each text with the model that has not seen it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.arrays import argmax
from topicloom.operators.classify import TokenBayes
from topicloom.operators.metrics import evaluation
from topicloom.runtime import cut
from topicloom.settings import SEED

FOLDS = 5
SMOOTHING = (0.1, 0.5, 1.0, 2.0)


def fold_of(id_col: str, folds: int = FOLDS, seed: int = SEED) -> Column:
    """The fold of a row, by the hash of its id; rows that repeat an id stay together."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def choose_smoothing(
    docs: DataFrame,
    id_col: str,
    label: str,
    tokens: Column,
    smoothing: tuple[float, ...] = SMOOTHING,
    folds: int = FOLDS,
) -> DataFrame:
    """``smoothing, n, accuracy, macro_f1, loss`` of leave-fold-out naive Bayes, best loss first.

    Tokens that a fold's model has not seen add nothing. Only sums per fold and
    class reach the driver. Rows without a label take no part.
    """
    rows = docs.where(F.col(label).isNotNull()).select(
        id_col, F.col(label).alias("_label"), fold_of(id_col, folds).alias("_fold"), tokens.alias("_tokens")
    )
    rows = cut(rows)
    n_docs: dict[tuple, int] = {}
    for r in rows.groupBy("_fold", "_label").agg(F.count(F.lit(1)).alias("n")).collect():  # folds x classes
        n_docs[r["_fold"], r["_label"]] = r["n"]
    classes = sorted({c for _, c in n_docs})
    width = len(classes)
    if not width:
        return docs.sparkSession.createDataFrame(
            [], "smoothing double, n bigint, accuracy double, macro_f1 double, loss double"
        )
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("_label")).cast("int") - 1
    rows = rows.withColumn("_truth", place)
    cell = (F.col("_fold") * width + F.col("_truth")).alias("_cell")
    counted = rows.select(cell, F.explode("_tokens").alias("token")).groupBy("token", "_cell")
    counted = counted.agg(F.count(F.lit(1)).alias("n"))
    cells = F.sequence(F.lit(0), F.lit(folds * width - 1))
    zero = F.lit(0).cast("bigint")
    by_token = counted.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("_cell", "n"))).alias("m"))
    by_token = cut(by_token.select("token", F.transform(cells, lambda i: F.coalesce(F.try_element_at("m", i), zero)).alias("n")))

    def total(c: int) -> Column:
        return sum((F.get("n", F.lit(g * width + c)) for g in range(folds)), zero)

    def less(f: int, c: int) -> Column:
        return total(c) - F.get("n", F.lit(f * width + c))

    # Tokens and vocabulary of every fold's model.
    sums = {f"t{f}_{c}": F.coalesce(F.sum(less(f, c)), zero) for f in range(folds) for c in range(width)}
    sizes = {f"v{f}": F.count_if(sum((less(f, c) for c in range(width)), zero) > 0) for f in range(folds)}
    found = by_token.agg(*[x.alias(k) for k, x in {**sums, **sizes}.items()]).first()
    weights = None
    for f in range(folds):
        size = found[f"v{f}"]
        w = [
            F.ln(less(f, c) + F.lit(s)) - F.lit(math.log(found[f"t{f}_{c}"] + s * size) if size else 0.0)
            for s in smoothing
            for c in range(width)
        ]
        # A token that only this fold has, or that it lacks, is never looked up for a text of it.
        own = sum((F.get("n", F.lit(f * width + c)) for c in range(width)), zero)
        seen = by_token.where((sum((less(f, c) for c in range(width)), zero) > 0) & (own > 0))
        part = seen.select(F.concat(F.lit(f"{f}:"), "token").alias("token"), F.array(*w).alias("w"))
        weights = part if weights is None else weights.unionByName(part)
    model = TokenBayes(list(range(len(smoothing) * width)), [0.0] * (len(smoothing) * width), cut(weights))
    keyed = F.transform("_tokens", lambda t: F.concat(F.col("_fold").cast("string"), F.lit(":"), t))
    scored = model.logits(rows, ["_truth", "_fold"], keyed)

    def prior(f: int, c: int, s: float) -> float:
        mine = sum(n for (g, label_), n in n_docs.items() if g != f and label_ == classes[c])
        every = sum(n for (g, _), n in n_docs.items() if g != f)
        return math.log(mine + s) - math.log(every + s * width)

    of_fold = F.array(*[
        F.array(*[F.lit(prior(f, c, s)) for s in smoothing for c in range(width)]) for f in range(folds)
    ])
    logits = F.zip_with("logits", F.get(of_fold, F.col("_fold")), lambda x, p: x + p)
    each = F.transform(
        F.array(*[F.struct(F.lit(s).alias("s"), F.lit(i * width + 1).alias("at")) for i, s in enumerate(smoothing)]),
        lambda g: F.struct(g["s"].alias("smoothing"), F.slice("_all", g["at"], F.lit(width)).alias("logits")),
    )
    rows = scored.withColumn("_all", logits).select("_truth", F.explode(each).alias("e")).select("_truth", "e.*")
    rows = rows.withColumn("_pred", argmax(F.col("logits")))
    return evaluation(rows, "_truth", "_pred", "logits", by=["smoothing"]).orderBy("loss", "smoothing")


def fit_label_bayes(docs: DataFrame, labels: Column, tokens: Column, smoothing: float = 1.0) -> TokenBayes:
    """One naive Bayes per label against all texts without it; logits are log-odds.

    ``labels`` is an array of label names, which may be empty. A token has one row
    with a weight per label; texts with a label are counted through their pairs
    only, so the counts of the others follow by subtraction.
    """
    rows = cut(docs.select(F.array_distinct(labels).alias("_labels"), tokens.alias("_tokens")))
    n = rows.count()
    counts = rows.select(F.explode("_labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    with_label = {r["label"]: r["n"] for r in counts.orderBy("label").collect()}  # one row per label
    names = list(with_label)
    pairs = rows.select("_labels", F.explode("_tokens").alias("token"))
    every = pairs.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(x) for x in names]).cast("array<string>"), F.col("label")).cast("int") - 1
    each = pairs.select("token", F.explode("_labels").alias("label")).groupBy("token", "label")
    each = each.agg(F.count(F.lit(1)).alias("c")).select("token", place.alias("at"), "c")
    by_token = each.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("m"))
    by_token = cut(every.join(by_token, "token", "left"))

    def hits(i: int) -> Column:
        return F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0).cast("bigint"))

    found = by_token.agg(
        F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        *[F.coalesce(F.sum(hits(i)), F.lit(0)).alias(f"c{i}") for i in range(len(names))],
    ).first()
    size, s = found["size"], smoothing
    weights, priors = [], []
    for i, name in enumerate(names):
        yes, no = found[f"c{i}"], found["n"] - found[f"c{i}"]
        base = math.log(yes + s * size) - math.log(no + s * size) if size else 0.0
        weights.append(F.ln(hits(i) + F.lit(s)) - F.ln(F.col("n") - hits(i) + F.lit(s)) - F.lit(base))
        priors.append(math.log(with_label[name] + s) - math.log(n - with_label[name] + s))
    w = F.array(*weights).cast("array<double>").alias("w")
    return TokenBayes(names, priors, by_token.select("token", w))


def predict_labels(docs: DataFrame, ids: list[str], model: TokenBayes, tokens: Column) -> DataFrame:
    """``(ids, label)``: the labels whose odds are better than even."""
    odds = model.logits(docs, ids, tokens).select(*ids, F.posexplode("logits").alias("_at", "_odds"))
    return odds.where(F.col("_odds") > 0).select(*ids, model.class_name(F.col("_at")).alias("label"))
