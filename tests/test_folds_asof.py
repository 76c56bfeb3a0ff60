"""As-of joins over hot keys and many ranges, and leave-fold-out models against plain counts."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topicloom.functions.text import tokenize
from topicloom.operators import asof, folds
from topicloom.runtime import cut


def plain_asof(left, right, strict):
    out = []
    for i, k, t in left:
        best = max(
            ((rt, tie, v) for tie, rk, rt, v in right
             if k is not None and t is not None and rk == k and rt is not None and (rt < t if strict else rt <= t)),
            default=None,
        )
        out.append((i, k, t, best and best[1], best and best[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("parts", [1, 9])
def test_asof_equals_plain(spark, strict, parts):
    rng = random.Random(parts)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "only left", None])
    left = [(i, key(), rng.choice([*range(60), None])) for i in range(400)]
    right = [(i, rng.choice(["hot", "hot", "a", "b", "only right", None]), rng.choice([*range(60), None]), i / 2)
             for i in range(120)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        a = cut(spark.createDataFrame(left, "id int, k string, t int"))
        b = cut(spark.createDataFrame(right, "no int, k string, t int, v double"))
        got = asof.asof_join(a, b, "k", "t", "no", {"no": "last_no", "v": "last_v"}, strict)
        assert got.columns == ["id", "k", "t", "last_no", "last_v"]
        assert sorted(map(tuple, got.collect()), key=str) == plain_asof(left, right, strict)
        assert asof.asof_join(a.limit(0), b, "k", "t", "no", {"v": "x"}).count() == 0
        none = asof.asof_join(a, b.limit(0), "k", "t", "no", {"v": "x"})
        assert none.count() == 400 and none.where("x IS NOT NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


WORDS = ["a", "b", "c", "d", "e", "f"]


def texts(rng, n):
    return [(i, rng.choice("xy"), " ".join(rng.choices(WORDS[:4] if i % 2 else WORDS, k=rng.randrange(0, 6)))) for i in range(n)]


def plain_loss(rows, fold, s, k):
    total, right = 0.0, 0
    for f in range(k):
        train = [r for r in rows if fold[r[0]] != f]
        docs, words = Counter(r[1] for r in train), {c: Counter() for c in "xy"}
        for _, c, t in train:
            words[c].update(t.split())
        vocab = set(words["x"]) | set(words["y"])
        for i, c, t in rows:
            if fold[i] == f:
                logit = {}
                for label in "xy":
                    base = math.log(sum(words[label].values()) + s * len(vocab))
                    logit[label] = math.log(docs[label] + s) - math.log(len(train) + 2 * s) + sum(
                        math.log(words[label][w] + s) - base for w in t.split() if w in vocab
                    )
                top = max(logit.values())
                total += top + math.log(sum(math.exp(v - top) for v in logit.values())) - logit[c]
                right += max(sorted(logit), key=logit.get) == c
    return round(total / len(rows), 9), right / len(rows)


def test_leave_fold_out_equals_training_every_fold(spark):
    rows = texts(random.Random(3), 60)
    docs = cut(spark.createDataFrame([*rows, (99, None, "a b")], "doc_id long, lang string, text string"))
    fold = {r.doc_id: r.f for r in docs.select("doc_id", folds.fold_of("doc_id", 3).alias("f")).collect()}
    got = folds.choose_smoothing(docs, "doc_id", "lang", tokenize(F.col("text")), (0.5, 2.0), 3).collect()
    assert [r.loss for r in got] == sorted(r.loss for r in got) and {r.n for r in got} == {60}
    for r in got:
        loss, accuracy = plain_loss(rows, fold, r.smoothing, 3)
        assert round(r.loss, 9) == loss and abs(r.accuracy - accuracy) < 1e-12
    assert folds.choose_smoothing(docs.where("lang IS NULL"), "doc_id", "lang", tokenize(F.col("text"))).count() == 0


def test_label_models_take_any_labels(spark):
    rows = [(1, ["p"], "a a b"), (2, ["p", "q"], "a c"), (3, [], "d d"), (4, ["q"], "c c d"), (5, None, "e")]
    docs = cut(spark.createDataFrame(rows, "id int, labels array<string>, text string"))
    model = folds.fit_label_bayes(docs, F.col("labels"), tokenize(F.col("text")))
    assert model.classes == ["p", "q"]
    asked = cut(spark.createDataFrame([(1, "a a"), (1, "c"), (None, "d"), (7, None)], "id int, text string"))
    got = folds.predict_labels(asked, ["id"], model, tokenize(F.col("text"))).collect()
    assert sorted((r.id, r.label) for r in got) == [(1, "p"), (1, "q")]
