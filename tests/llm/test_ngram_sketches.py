"""Pairs of crowded n-grams are judged by sketches and in rounds: the sets of unlike documents stay where they are."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import jaccard
from topicloom.llm.common import numbered
from topicloom.runtime import cut


def _shingles(text, n):
    w = text.lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def _corpus(seed):
    """Unlike documents of some of the same passages, and groups of near copies, each like its first."""
    rng = random.Random(seed)
    words = lambda n: ["".join(rng.choices("klmnopqr", k=6)) for _ in range(n)]
    passages = [words(9) for _ in range(24)]
    texts = [" ".join(sum(rng.sample(passages, rng.randint(7, 9)), [])) for _ in range(40)]
    for base in (0, 3):
        held = texts[base].split()
        for _ in range(8):
            made = list(held)
            made[rng.randrange(len(made))] = words(1)[0]
            texts.append(" ".join(made))
    return texts


def _groups(texts, n, num, den):
    """The least id that links lead to, by comparing all."""
    sets, up = [_shingles(t, n) for t in texts], list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if den * len(x & y) >= num * len(x | y):
                    up[i] = up[j] = min(up[i], up[j])
    return up


def _found(spark, texts, n, num, den):
    docs = numbered(cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "row")
    got = jaccard.similar_groups(docs, "row", "doc_id", "text", n, num, den).collect()
    return [r.component_id for r in sorted(got, key=lambda r: r.doc_id)]


def test_sets_of_unlike_documents_do_not_travel(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIR_LIMIT", 3)
    texts, asked, sets_of = _corpus(1), [], jaccard._sets_of

    def spied(rows, wanted, n):
        asked.append(wanted.distinct().count())
        return sets_of(rows, wanted, n)

    monkeypatch.setattr(jaccard, "_sets_of", spied)
    want = _groups(texts, 3, 8, 10)
    assert _found(spark, texts, 3, 8, 10) == want
    assert len(set(want)) == 40 and max(asked) <= 2 * 9


@pytest.mark.parametrize("limit", [1, 3, 64])
def test_rounds_equal_brute_force(spark, monkeypatch, limit):
    for name, value in (("PAIR_LIMIT", limit), ("PAIR_ROWS", 1), ("PAIR_WEIGHT", 1500), ("BLOCK_WEIGHT", 500)):
        monkeypatch.setattr(jaccard, name, value)
    texts = _corpus(limit) + ["one two", "one two", "ONE  two", "alone", ""]
    want = _groups(texts[:-1], 3, 8, 10) + [len(texts) - 1]
    assert _found(spark, texts, 3, 8, 10) == want


def test_sketches_differ_in_no_more_than_their_sets():
    rng = np.random.default_rng(2)
    for size in (1, 2, 63, 64, 65, 500, 3000):
        one = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        for swapped in (0, 1, size // 3):
            two = np.unique(np.concatenate([one[swapped:], rng.integers(0, 1 << 63, swapped + size // 5, dtype=np.uint64)]))
            x, y = (jaccard._sketch(s).view(np.uint64) for s in (one, two))
            words = min(len(x), len(y))
            differ = np.bitwise_count(jaccard._folded(x, words) ^ jaccard._folded(y, words)).sum()
            assert differ <= len(np.setxor1d(one, two)) and 64 * len(x) >= len(one)


def test_shuffle_files_go_with_the_written_table(spark):
    """They stayed until the driver collected its garbage."""
    import time

    place = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = place.getAllFiles().mkString("\n").split("\n")
        return {f for f in files if "/shuffle_" in f}

    before = shuffled()
    rows = spark.range(0, 10000, 1, 4).groupBy((F.col("id") % 97).alias("k")).agg(F.max("id").alias("m"))
    assert cut(rows).count() == 97
    with_table = cut(rows.join(rows.withColumnRenamed("m", "o"), "k"))
    for _ in range(50):
        left = shuffled() - before
        if len(left) < 2:  # the count above may have one
            break
        time.sleep(0.1)
    assert with_table.count() == 97 and len([f for f in left if f.endswith(".data")]) <= 1
