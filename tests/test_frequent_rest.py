"""Of a table too large to be sent, only what a row holds beyond its most frequent tokens is exchanged."""

import pytest
from pyspark.sql import functions as F

from topicloom.functions.text import tokenize
from topicloom.operators import classify, folds, joins, summary, vocab

N = 4000


@pytest.fixture(scope="module")
def docs(spark):
    own = F.concat(F.lit("z"), F.col("id").cast("string"))
    body = F.concat(F.lit("a a a a a a a a a b. "), own, F.lit(" c "), own, F.lit(". b"))
    text = F.when(F.col("id") % 100 == 99, F.lit("")).otherwise(body)
    lang = F.when(F.col("id") % 2 == 0, F.lit("x")).otherwise(F.lit("y"))
    return spark.range(N).select(F.col("id").alias("doc_id"), text.alias("text"), lang.alias("lang")).cache()


def _tok():
    return tokenize(F.col("text"))


def _encoded(docs, limit):
    words = vocab.build_vocab(docs.where("doc_id % 10 <> 0"), "doc_id", _tok())
    got = vocab.encode(docs, ["doc_id"], _tok(), words, limit=limit, counted=True)
    return [(r.doc_id, r.seq, r.n_unk) for r in got.collect()]


def _logits(docs, limit):
    model = classify.fit_token_bayes(docs.where("doc_id % 10 <> 0"), "lang", _tok())
    return [(r.doc_id, [round(x, 6) for x in r.logits]) for r in model.logits(docs, ["doc_id"], _tok(), limit).collect()]


def _embedded(docs, limit):
    weights = summary.idf_table(docs.where("doc_id % 10 <> 0"), _tok())
    got = summary.doc_embedding(docs, "doc_id", _tok(), 8, weights, limit).collect()
    return [(r.doc_id, [round(x, 6) for x in r.embedding]) for r in got]


def _short(docs, limit):
    weights = summary.idf_table(docs.where("doc_id % 10 <> 0"), _tok())
    return [(r.doc_id, r.summary) for r in summary.extractive_summary(docs, "doc_id", "text", 1, weights, limit).collect()]


@pytest.mark.parametrize("run", [_encoded, _logits, _embedded, _short])
def test_frequent_tokens_are_not_exchanged(docs, monkeypatch, run):
    want = sorted(run(docs, 1 << 26))
    exchanged = []
    original = joins.lookup_join

    def record(facts, dim, on, *args, **kwargs):
        exchanged.append(facts.count())
        return original(facts, dim, on, *args, **kwargs)

    for module in (joins, vocab, classify, summary):
        monkeypatch.setattr(module, "lookup_join", record, raising=False)
    assert sorted(run(docs, 3000)) == want and len(want) == N
    assert exchanged == [N - N // 100]  # once for the token that only its document has


def test_frequent_rows_take_what_fits(spark):
    table = spark.createDataFrame([(f"k{i}", 1 << i) for i in range(14)], "token string, idx bigint")
    _, size = joins.measure(table)
    got = joins.frequent_rows(table, F.col("idx"), limit=size // 2, hot_share=2.0).collect()
    assert sorted(r.idx for r in got) == [1 << i for i in range(7, 14)]
    assert joins.frequent_rows(table.limit(0), F.col("idx")).count() == 0


def test_folds_keep_no_weight_that_no_text_looks_up(docs, monkeypatch):
    kept = []
    original = folds.TokenBayes
    monkeypatch.setattr(folds, "TokenBayes", lambda *a: kept.append(a[2]) or original(*a))
    got = folds.choose_smoothing(docs, "doc_id", "lang", _tok())
    assert got.count() == len(folds.SMOOTHING)
    assert sorted({r.token.split(":")[1] for r in kept[0].collect()}) == ["a", "b", "c"]


def test_features_are_made_once_for_all_kinds(docs, monkeypatch):
    made = []
    original = classify.IDF
    monkeypatch.setattr(classify, "IDF", lambda **a: made.append(1) or original(**a))
    rows = docs.limit(60).select("lang", _tok().alias("tokens"))
    got = classify.choose_model(rows, rows, "lang", classify.model_kinds(), {"features": 64}).collect()
    assert sorted(r.kind for r in got) == classify.model_kinds() and len(made) == 1
