"""From labelled texts to encoded data sets, and from them to a scored model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.arrays import argmax, pad
from topicloom.functions.text import tokenize
from topicloom.operators.classify import TokenBayes, fit_token_bayes
from topicloom.operators.joins import lookup_join
from topicloom.operators.metrics import evaluation
from topicloom.operators.split import exact_split, stratified_split
from topicloom.operators.vocab import build_vocab, encode, label_index
from topicloom.settings import MAX_LEN, SEED, TEST_PART, VAL_PART


@dataclass
class Prepared:
    """Vocabulary and encoded rows ``(id, seq, target, part)``."""

    vocab: DataFrame
    rows: DataFrame


def with_targets(df: DataFrame, label: str) -> DataFrame:
    """``df`` with the label's number in ``target``."""
    return lookup_join(df, label_index(df, label), label).withColumn(
        "target", F.col("target").cast("int")
    )


def prepare(
    docs: DataFrame,
    id_col: str,
    text: str,
    target: str,
    max_len: int = MAX_LEN,
    val_part: float = VAL_PART,
    fit_on: str = "all",
    seed: int = SEED,
) -> Prepared:
    """Split, build the vocabulary, encode and pad.

    ``fit_on='all'`` also counts the tokens of the validation rows, ``'train'``
    leaves them out.
    """
    parts = exact_split(docs.select(id_col, text, target), id_col, val_part, seed)
    base = parts if fit_on == "all" else parts.where(F.col("part") == "train")
    tokens = tokenize(F.col(text))
    vocab = build_vocab(base, id_col, tokens)
    coded = encode(parts, [id_col, target, "part"], tokens, vocab, counted=fit_on == "all")
    return Prepared(
        vocab,
        coded.select(id_col, pad(F.col("seq").cast("array<int>"), max_len).alias("seq"), target, "part"),
    )


def train_test(docs: DataFrame, id_col: str, by: str, part: float = TEST_PART, seed: int = SEED):
    """The two sides of a stratified split."""
    split = stratified_split(docs, id_col, by, part, seed)
    return tuple(split.where(F.col("part") == p).drop("part") for p in ("train", "test"))


def train(docs: DataFrame, label: str, text: str = "text", smoothing: float = 1.0) -> TokenBayes:
    """A topic model from labelled texts."""
    return fit_token_bayes(docs, label, tokenize(F.col(text)), smoothing)


def evaluate(model: TokenBayes, test: DataFrame, id_col: str, label: str, text: str = "text"):
    """Accuracy, macro F1 and loss of a model on labelled texts."""
    ids = [id_col, "truth"]
    rows = test.select(id_col, model.class_id(F.col(label)).cast("int").alias("truth"), text)
    scored = model.logits(rows, ids, tokenize(F.col(text))).withColumn(
        "pred", argmax(F.col("logits"))
    )
    return evaluation(scored, "truth", "pred", "logits")
