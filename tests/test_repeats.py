"""Repeated and missing ids are rows of their own; splits stay exact on them."""

import pytest
from pyspark.sql import functions as F

from topicloom.functions.text import tokenize
from topicloom.operators import classify, lookup, metrics, split, summary, vocab
from topicloom.plans import training
from topicloom.runtime import cut
from topicloom.streaming import jobs

DOCS = "doc_id bigint, lang string, text string"
TEXTS = [
    (1, "x", "a b. c d e. a a"), (1, "x", "d e f. a"), (None, "y", "b b. c"), (None, "y", "f. e a"),
    (2, None, ""), (3, "x", None),
]


def tok(c="text"):
    return tokenize(F.col(c))


@pytest.fixture(scope="module")
def docs(spark):
    return cut(spark.createDataFrame(TEXTS, DOCS))


def part_sizes(rows, name):
    return rows.where(F.col("part") == name).count(), rows.count()


@pytest.mark.parametrize("parts", [1, 7])
def test_splits_are_exact_on_repeated_ids(spark, parts):
    data = [(1, "x", f"t{i}") for i in range(20)] + [(2, "x", "t"), (None, "x", "n"), (None, "x", "n")]
    rows = cut(spark.createDataFrame(data, DOCS).repartition(parts))
    assert part_sizes(split.exact_split(rows, "doc_id", 0.2), "val") == (4, 23)
    assert part_sizes(split.stratified_split(rows, "doc_id", "lang", 0.2), "test") == (4, 23)
    for k in (0, 1, 10, 22, 23):
        assert part_sizes(split.exact_split(rows, "doc_id", (k + 0.5) / 23), "val") == (min(k, 23), 23)
    twice = [
        sorted(tuple(map(str, r)) for r in split.stratified_split(rows.repartition(n), "doc_id", "lang", 0.2).collect())
        for n in (1, 5)
    ]
    assert twice[0] == twice[1]


def test_embeddings_and_summaries_keep_every_row(spark, docs):
    for limit in (1 << 26, 0):
        vectors = summary.doc_embedding(docs, "doc_id", tok(), 8, limit=limit)
        got = sorted((str(r.doc_id), [round(x, 9) for x in r.embedding]) for r in vectors.collect())
        assert len(got) == len(TEXTS)
        short = summary.extractive_summary(docs, "doc_id", "text", 1, limit=limit)
        texts = sorted((str(r.doc_id), r.summary) for r in short.collect())
        assert len(texts) == len(TEXTS)
        if limit:
            want, wanted = got, texts
    assert got == want and texts == wanted
    assert {s for i, s in texts if i == "1"} == {"c d e.", "d e f."}


def test_rouge_and_label_sets_keep_every_row(spark, docs):
    pairs = cut(docs.select("doc_id", tok().alias("cand"), F.array(F.lit("a"), F.lit("b")).alias("ref")))
    one = metrics.rouge_n(pairs, ["doc_id"], "cand", "ref", 1).collect()
    assert len(one) == len(TEXTS) == metrics.rouge_l(pairs, ["doc_id"], "cand", "ref").count()
    assert sorted(r.overlap for r in one if r.doc_id == 1) == [1, 2]
    sets = vocab.label_sets(docs, ["doc_id"], tok()).collect()
    assert len(sets) == len(TEXTS)


def test_a_stream_sends_its_model_once(spark, docs, tmp_path, monkeypatch):
    sent = []
    original = classify.send
    monkeypatch.setattr(classify, "send", lambda *a: sent.append(1) or original(*a))
    model = training.train(docs, "lang")
    drops = str(tmp_path / "drops")
    for i in range(3):
        docs.where("doc_id IS NOT NULL").coalesce(1).write.mode("append").parquet(drops)
    stream = jobs.file_stream(spark, drops, docs.schema, files_per_batch=1)
    jobs.score_stream(stream, ["doc_id"], model, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    assert len(sent) == 1
    model.release()
    model.logits(docs, ["doc_id"], tok()).count()
    assert len(sent) == 2


def test_lookups_of_empty_batches(spark, docs):
    table = spark.createDataFrame([("a", 1, 2.0)], "token string, at int, w double")
    sent = lookup.send(table, "token", "at", "w")
    got = lookup.hashed_sums(docs, ["doc_id"], tok(), sent, 2, "v").collect()
    assert {tuple(r.v) for r in got} == {(0.0, 1.0), (0.0, 0.0)}
