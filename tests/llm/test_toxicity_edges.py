"""Toxicity on empty tables, repeated rows and clashing names; its kernel against plain Python."""

import itertools
import random

import numpy as np
import pytest
from topicloom.llm import toxicity
from topicloom.runtime import cut

COLUMNS = "doc_id long, text string, toxic int"


def plain_kernel(a, b):
    """Gap-weighted subsequences of three letters, the first mark included, within the span."""
    def weights(w):
        w, out = "^" + w, {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN:
                code = w[i] + w[j] + w[k]
                out[code] = out.get(code, 0) + toxicity.DECAY ** (k - i + 1)
        # The norm counts every occurrence on its own.
        norm = sum(toxicity.DECAY ** (2 * (k - i + 1)) for i, _, k in itertools.combinations(range(len(w)), 3)
                   if k - i < toxicity.SPAN) ** 0.5
        return out, max(norm, 1e-12)

    (x, nx), (y, ny) = weights(a), weights(b)
    value = sum(x[c] * y.get(c, 0) for c in x) / nx / ny
    return min(value, 1) ** toxicity.POWER if value >= toxicity.LEAST else 0.0


def test_kernel_equals_plain_python():
    rng = random.Random(1)
    words = ["idiot", "idxiot", "id1ot", "stupid", "stuxpid", "stu", "st", "", "idiotidiot", "clean"]
    words += ["".join(rng.choice("abid") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    marks = ["idiot", "stupid", "abba"]
    got = toxicity.Landmarks(marks).compare([toxicity.letters(w) for w in words])
    want = [[plain_kernel(toxicity.letters(w), m) for m in marks] for w in words]
    # A value at the border may fall on either side of it.
    close = np.abs(np.array(want) - got) < 1e-4
    border = np.abs(np.sqrt(np.maximum(np.array(want), got)) - toxicity.LEAST) < 1e-4
    assert (close | border).all()


def rows_of(rng, n):
    clean = [f"word{i}" for i in range(60)]
    for i in range(n):
        text = " ".join(rng.choices(clean, k=12))
        yield i, f"{text} idiot stupid" if i % 3 == 0 else text, int(i % 3 == 0)


def test_repeated_rows_change_nothing(spark):
    rows = list(rows_of(random.Random(2), 300))
    once = cut(spark.createDataFrame(rows, COLUMNS))
    # A third of all rows are copies of one text.
    often = cut(spark.createDataFrame(rows + [rows[3]] * 150 + [(7, None, 1), (8, "x", None), (9, "", 0)], COLUMNS))
    a, b = toxicity.train(once, "text", "toxic"), toxicity.train(often, "text", "toxic")
    assert set(a.words) == set(b.words) and a.words
    got = toxicity.score(often, "text", b, "s").collect()
    assert len(got) == 453 and all(0 <= r.s <= 1 for r in got)
    assert all((r.s >= 0.5) == bool(r.toxic) for r in got if r.text and r.toxic is not None and r.text != "x")


def test_edges(spark):
    none = cut(spark.createDataFrame([], COLUMNS))
    model = toxicity.train(none, "text", "toxic")
    assert toxicity.score(none, "text", model, "s").count() == 0
    with pytest.raises(ValueError, match="already"):
        toxicity.score(none, "text", model, "Toxic")
