"""Sequences and logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.settings import MAX_LEN, PAD_ID


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pad(seq: Column, max_len: int = MAX_LEN, pad_id: int = PAD_ID) -> Column:
    """Exactly ``max_len`` entries: cut on the right or filled up with ``pad_id``."""
    kept = F.slice(seq, 1, max_len)
    return F.concat(kept, F.array_repeat(F.lit(pad_id), F.lit(max_len) - F.size(kept)))


def softmax(logits: Column) -> Column:
    """Class probabilities; shifted by the largest logit, so it cannot overflow."""
    def shares(exps):
        total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
        return F.transform(exps, lambda x: x / total)

    def shifted(v):
        top = F.array_max(v)
        return F.transform(v, lambda x: F.exp(x - top))

    return let(let(logits.cast("array<double>"), shifted), shares)


def argmax(logits: Column) -> Column:
    """Index of the largest logit, the first one of several; -1 for an empty array."""
    return F.coalesce(
        (F.array_position(logits, F.array_max(logits)) - 1).cast("int"),
        F.when(logits.isNotNull(), F.lit(-1)),
    )


def log_loss(logits: Column, label: Column) -> Column:
    """Cross-entropy of one row: log-sum-exp of the logits minus the label's logit."""
    def loss(v):
        top = F.array_max(v)
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return F.log(total) + top - F.get(v, label)

    return let(logits.cast("array<double>"), loss)


def multi_hot(labels: Column, size: int) -> Column:
    """Zero/one array of ``size`` from an array of label indices."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.array_contains(labels, i).cast("int"),
    )
