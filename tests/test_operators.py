import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions import text
from topicloom.operators import (
    classify, clean, extract, frontier, joins, metrics, ranking, similar, split, summary, vocab,
)
from topicloom.settings import NO_DATE, NO_HUBS, NO_SUMMARY, NO_TAGS, NO_TEXT, NO_TITLE
from tests.test_functions import PAGE

def tok():
    return text.tokenize(F.col("text"))


DOCS = [(3, "b a b", "x"), (1, "c a", "y"), (2, "", "x"), (9, None, "y"), (5, "d, D c!", "x")]


def docs(spark, parts=None):
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string")
    return df.repartition(parts) if parts else df


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_vocab_is_first_seen_order(spark, parts):
    got = dict((t, (i, n)) for t, i, n in rows(vocab.build_vocab(docs(spark, parts), "doc_id", tok()), "token", "idx", "n"))
    assert got == {"<unk>": (0, 0), "c": (1, 2), "a": (2, 2), "b": (3, 2), "d": (4, 2)}


def test_vocab_of_far_ids_and_long_texts(spark, monkeypatch):
    want = {"<unk>": 0, "z": 1, "y": 2, "x": 3}
    far = spark.createDataFrame([((1 << 62), "x y"), (-(1 << 62), "z y z")], "doc_id bigint, text string")
    assert dict(rows(vocab.build_vocab(far, "doc_id", tok()), "token", "idx")) == want
    monkeypatch.setattr(vocab, "_POS_BITS", 1)  # a third position does not fit
    near = spark.createDataFrame([(8, "x y"), (7, "z y z")], "doc_id bigint, text string")
    assert dict(rows(vocab.build_vocab(near, "doc_id", tok()), "token", "idx")) == want


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_encode_keeps_every_document(spark, limit):
    words = vocab.build_vocab(docs(spark).where("doc_id < 5"), "doc_id", tok())
    got = {r["doc_id"]: r for r in vocab.encode(docs(spark), ["doc_id"], tok(), words, limit=limit).collect()}
    assert got[3]["seq"] == [3, 2, 3] and got[1]["seq"] == [1, 2]
    assert got[2]["seq"] == [] and got[2]["unk_rate"] is None and got[2]["n_tokens"] == 0
    assert got[9]["seq"] == []
    assert got[5]["seq"] == [0, 0, 1] and got[5]["n_unk"] == 2
    assert abs(got[5]["unk_rate"] - 2 / 3) < 1e-12


@pytest.mark.parametrize("limit", [0, 2000, 20000])
def test_encode_with_part_of_the_vocabulary_broadcast(spark, sf, limit):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    empty = spark.range(10_000, 10_100).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    given = given.select("doc_id", "text").union(empty)
    words = vocab.build_vocab(given, "doc_id", tok())
    want = rows(vocab.encode(given, ["doc_id"], tok(), words), "doc_id", "seq", "n_unk")
    assert len(want) == given.count()
    for counted in (True, False):
        got = vocab.encode(given, ["doc_id"], tok(), words, limit=limit, counted=counted)
        assert rows(got, "doc_id", "seq", "n_unk") == want


def test_frequent_takes_every_hot_key_and_what_fits(spark):
    counts = spark.createDataFrame([(f"k{i}", 1 << i) for i in range(12)] + [("z", 0)], "k string, n bigint")
    top = lambda room, share: sorted(int(r[0][1:]) for r in joins._frequent(counts, room, share).collect())
    assert top(0, 0.4) == [10, 11] and top(0, 2.0) == []
    assert top(5, 2.0) == [7, 8, 9, 10, 11] and top(100, 2.0) == list(range(12))
    assert joins._frequent(counts.limit(0), 5, 0.1).count() == 0


def test_decode_gives_the_tokens_back(spark):
    words = vocab.build_vocab(docs(spark), "doc_id", tok())
    names = {i: t for t, i in rows(words, "token", "idx")}
    for r in vocab.encode(docs(spark), ["doc_id"], tok(), words).join(docs(spark), "doc_id").collect():
        assert " ".join(names[i] for i in r["seq"]) == " ".join(
            "".join(c for c in w if c.isalnum()) for w in (r["text"] or "").lower().split()
        )


def test_ensure_unk(spark):
    v = spark.createDataFrame([("a", 0), ("b", 4)], "token string, idx bigint")
    assert rows(vocab.ensure_unk(v), "token", "idx") == [("<unk>", 5), ("a", 0), ("b", 4)]
    assert vocab.ensure_unk(vocab.ensure_unk(v)).count() == 3
    assert rows(vocab.ensure_unk(v.limit(0)), "token", "idx") == [("<unk>", 1)]


def test_lookup_join_splits_hot_keys(spark):
    facts = [(i, "hot" if i % 3 else f"k{i}") for i in range(300)]
    dim = [("hot", 1)] + [(f"k{i}", i) for i in range(0, 300, 6)]
    f = spark.createDataFrame(facts, "i int, k string")
    d = spark.createDataFrame(dim, "k string, v int")
    f = f.union(spark.createDataFrame([(-i, None) for i in range(1, 200)], f.schema))
    want = sorted([(i, k, dict(dim).get(k, -1)) for i, k in facts] + [(-i, "", -1) for i in range(1, 200)])
    for limit in (0, 1 << 20):
        got = joins.lookup_join(f, d, "k", limit, hot_share=0.1)
        assert rows(got, "i", F.coalesce("k", F.lit("")), F.coalesce("v", F.lit(-1))) == want


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(5)
    got = rows(ranking.dense_index(df, ["x"], "i", 10), "x", "i")
    assert got == [(x, i + 10) for i, x in enumerate(sorted(r[0] for r in got))]


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_drop_repeats(spark, limit):
    data = [("u", 2, "b"), ("u", 1, "a"), ("v", 3, "c"), ("v", 3, "c"), ("w", 4, "d"), (None, 6, "f"), (None, 5, "e"),
            ("x", None, "h"), ("x", 7, "g")]
    df = spark.createDataFrame(data, "url string, page_id bigint, html string")
    once = ranking.drop_repeats(df, "url", "page_id", limit)
    assert sorted(map(str, (r["html"] for r in once.collect()))) == ["a", "c", "d", "e", "h"]
    assert ranking.drop_repeats(df.limit(0), "url", "page_id", limit).count() == 0


def test_drop_repeats_moves_no_page(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    once = ranking.drop_repeats(pages.union(pages), "url", "page_id")
    assert once.count() == pages.count()
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_labels(spark):
    assert rows(vocab.label_index(docs(spark), "lang"), "lang", "target") == [("x", 0), ("y", 1)]
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "label int")
    out = vocab.remap_max_label(df, "label", vocab.max_label(df, "label"))
    assert sorted((r[0] is None, r[0]) for r in out.where("label is not null").collect()) == [
        (False, 0), (False, 1), (False, 2)
    ]
    zero_based = spark.createDataFrame([(0,), (1,)], "label int")
    fixed = vocab.remap_max_label(zero_based, "label", F.lit(7))
    assert rows(fixed, "label") == [(0,), (1,)]


def test_label_sets(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None)], "i int, l array<string>")
    got = {r[0]: r[1] for r in vocab.label_sets(df, ["i"], F.col("l")).collect()}
    assert got == {1: [0, 1], 2: [], 3: []}


def _brute_split(ids, part, seed=42):
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))
    return set(order[: math.floor(part * len(ids))])


@pytest.mark.parametrize("parts", [1, 7])
def test_splits_are_exact_and_stable(spark, parts):
    df = spark.range(997).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 9 > 0, "cold").alias("lang"),
    ).repartition(parts)
    by = {}
    for i, lang in [tuple(r) for r in df.collect()]:
        by.setdefault(lang, []).append(i)
    want = set().union(*[_brute_split(ids, 0.2) for ids in by.values()])
    got = split.stratified_split(df, "doc_id", "lang")
    assert got.count() == 997
    assert {r[0] for r in got.where("part = 'test'").select("doc_id").collect()} == want
    val = split.exact_split(df, "doc_id")
    assert {r[0] for r in val.where("part = 'val'").select("doc_id").collect()} == _brute_split(range(997), 0.05)
    assert split.exact_split(df.limit(3), "doc_id").where("part = 'val'").count() == 0


def test_frontier(spark):
    hubs = frontier.hub_table(spark, ["a", "b", "c"])
    assert rows(frontier.resume_from(hubs, "b"), "hub") == [("b",), ("c",)]
    assert rows(frontier.resume_from(hubs, "zz"), "hub") == [("a",), ("b",), ("c",)]
    assert rows(frontier.resume_from(hubs, None), "hub") == [("a",), ("b",), ("c",)]
    pages = spark.createDataFrame([("a", PAGE), ("a", "<p>"), ("b", "<p>")], "hub string, html string")
    last = frontier.last_page(pages, F.col("hub"), frontier.pager_links(F.col("html")))
    assert rows(last, "hub", "last_page") == [("a", 12), ("b", 1)]
    for cap, n in ((3, 3), (0, 12), (-1, 12), (50, 12)):
        urls = frontier.page_urls(hubs, last, cap)
        assert urls.where("hub = 'a'").count() == n and urls.where("hub = 'c'").count() == 1
    assert urls.where("hub = 'a' and page = 2").first()["url"].endswith("/ru/hubs/a/articles/page2/")
    links = frontier.page_links(pages, ["hub"])
    assert [r["url"][-14:] for r in links.orderBy("pos").collect()][0] == "/ru/articles/1/"[-14:]


def test_new_links_keep_the_first_hub(spark):
    links = spark.createDataFrame(
        [("b", 1, 0, "u1"), ("a", 0, 3, "u1"), ("a", 0, 1, "u2"), ("b", 1, 1, "u3"), ("b", 1, 2, "u3")],
        "hub string, ord int, pos int, url string",
    )
    store = spark.createDataFrame([("u2",), ("u2",)], "url string")
    fresh = frontier.new_links(links, store, [F.col("ord"), F.col("pos")])
    assert rows(fresh, "url", "hub", "pos") == [("u1", "a", 3), ("u3", "b", 1)]
    hubs = frontier.hub_table(spark, ["a", "b", "c"]).select("hub")
    assert rows(frontier.link_report(hubs, links, fresh), "hub", "found", "new") == [
        ("a", 2, 1), ("b", 3, 1), ("c", 0, 0)
    ]
    assert rows(frontier.hubs_without_links(hubs, links), "hub") == [("c",)]


def test_extract_and_errors(spark):
    pages = spark.createDataFrame([("u1", PAGE), ("u2", "<p>x</p>"), ("u3", None)], "url string, html string")
    got = {r["url"]: r for r in extract.extract_articles(pages, F.lit("hub")).collect()}
    assert set(got) == {"u1", "u2"}
    a = got["u1"]
    assert a["title"].startswith("Its <b>") and a["text"] == "one twothreefour"
    assert a["hubs"] == "Hub A *|Hub B" and a["tags"] == "ai|big data|sql&x" and a["date"] == "2024-01-02, 10:00"
    b = got["u2"]
    assert tuple(b)[2:] == (NO_TITLE, NO_TEXT, NO_SUMMARY, NO_HUBS, NO_TAGS, NO_DATE)
    errors = rows(extract.extract_errors(pages), "url", "error")
    assert errors == [("u2", f"no {n}") for n in ("date", "hubs", "tags", "text", "title")] + [
        ("u3", "page not fetched")
    ]


def test_clean_documents(spark):
    raw = spark.createDataFrame(
        [
            ("c", "/articles/1/", "t", NO_TEXT, "s", "a", "b", "d"),
            ("c", "/articles/2/", "t", None, "s", "*Распределенные системы*|Блог X", None, "d"),
            ("c", "/news/3/", "t", "x", "s", "a", "b", "d"),
            ("c", "/articles/4/", "t", "x", "s", "a|b", "q", "d"),
        ],
        "category string, url string, title string, text string, summary string, hubs string, tags string, date string",
    )
    got = {r["doc_id"]: r for r in clean.clean_documents(raw).collect()}
    assert set(got) == {2, 4}
    assert got[2]["hubs"] == ["Распределённые системы"] and got[2]["tags"] == []
    assert got[4]["hubs"] == ["a", "b"]
    assert clean.clean_documents(raw, drop_unlabelled=True).count() == 1
    assert tuple(clean.clean_counts(raw).first()) == (4, 1, 1, 2)


def _f1(truth, pred):
    out = []
    for c in set(truth) | set(pred):
        tp = sum(t == p == c for t, p in zip(truth, pred))
        out.append(2 * tp / (sum(t == c for t in truth) + sum(p == c for p in pred)))
    return sum(out) / len(out)


def test_classification_metrics(spark):
    truth, pred = [0, 0, 1, 1, 2, 3], [0, 1, 1, 1, 4, 3]
    df = spark.createDataFrame(list(zip(truth, pred)), "label int, pred int")
    assert abs(metrics.accuracy(df).first()[0] - 4 / 6) < 1e-12
    assert abs(metrics.macro_f1(df).first()[0] - _f1(truth, pred)) < 1e-12
    assert sum(r["n"] for r in metrics.confusion(df).collect()) == 6


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_rouge_against_brute_force(spark):
    rnd = random.Random(7)
    data = [
        (i, [rnd.choice("abcd") for _ in range(rnd.randint(0, 70))], [rnd.choice("abcd") for _ in range(rnd.randint(0, 90))])
        for i in range(40)
    ]
    df = spark.createDataFrame(data, "id int, c array<string>, r array<string>")
    for n in (1, 2, 3):
        got = dict(rows(metrics.rouge_n(df, ["id"], "c", "r", n), "id", "overlap"))
        for i, c, r in data:
            grams = [Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1)) for x in (c, r)]
            assert got[i] == sum((grams[0] & grams[1]).values())
    found = {r["id"]: r for r in metrics.rouge_l(df, ["id"], "c", "r").collect()}
    for i, c, r in data:
        want = _lcs(c, r)
        assert found[i]["overlap"] == want
        assert abs(found[i]["f1"] - (2 * want / (len(c) + len(r)) if c or r else 0)) < 1e-12


def test_v_measure(spark):
    same = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(30)], "c int, k int")
    assert [round(x, 9) for x in metrics.v_measure(same, "c", "k").first()] == [1, 1, 1]
    one = spark.createDataFrame([(i % 3, 0) for i in range(30)], "c int, k int")
    assert [round(x, 9) for x in metrics.v_measure(one, "c", "k").first()] == [0, 1, 0]


def test_multilabel_and_ranking_metrics(spark):
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "id int, label string")
    pred = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, label string")
    per = metrics.multilabel_f1(truth, pred, ["id"])
    assert rows(per, "label", "tp", "fp", "fn") == [("a", 1, 1, 1), ("b", 0, 1, 1)]
    assert [round(x, 9) for x in metrics.micro_f1(per).first()] == [0.25, round(2 / 6, 9)]
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id int, item int, rank int")
    pairs = spark.createDataFrame([(1, 10), (1, 12), (2, 99)], "query_id int, item int")
    marked = metrics.hits_by_pairs(ranked, pairs, "query_id", "item")
    relevant = pairs.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    got = metrics.precision_recall_at_k(marked, relevant, 2).first()
    assert (got["precision_at_k"], got["recall_at_k"], got["n_queries"]) == (0.25, 0.25, 2)


def _brute_similar(q, c, k):
    out = {}
    for qi, qv in q:
        sims = []
        for ci, cv in c:
            if ci != qi:
                a, b = np.float32(qv).astype(float), np.float32(cv).astype(float)
                n = np.linalg.norm(a) * np.linalg.norm(b)
                sims.append((-round(float(a @ b / n), 6) if n else 0.0, ci))
        out[qi] = sorted(sims)[:k]
    return out


def test_similar_blocks_equal_the_scan(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 3
    data = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=8)]) for i in range(150)]
    data += [(200 + i, data[5][1]) for i in range(60)]  # a group of copies
    data += [(400, [0.0] * 8)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    want = _brute_similar(data, data, 4)
    original = similar.best_of_blocks
    monkeypatch.setattr(similar, "best_of_blocks", lambda q, c, k, s: original(q, c, k, s, rows=16))
    for limit in (10_000, 10):
        got = {}
        for r in similar.top_k_similar(df, df, 4, max_queries=limit).collect():
            got.setdefault(r["query_id"], []).append((-r["cosine"] + 0.0, r["item_id"], r["rank"]))
        assert set(got) == set(want)
        for i, hits in got.items():
            hits = sorted(hits, key=lambda h: h[2])
            assert [(round(a, 6) + 0.0, b) for a, b, _ in hits] == [(a + 0.0, b) for a, b in want[i]], (limit, i)


def test_token_bayes(spark, tmp_path):
    model = classify.fit_token_bayes(docs(spark), "lang", tok())
    assert model.classes == ["x", "y"]
    w = {r["token"]: r["w"] for r in model.weights.collect()}
    # x has b a b d d c (6 tokens), y has c a (2); 4 distinct tokens
    assert abs(w["b"][0] - math.log(3 / 10)) < 1e-12 and abs(w["b"][1] - math.log(1 / 6)) < 1e-12
    path = str(tmp_path / "model")
    model.save(path)
    again = classify.TokenBayes.load(spark, path)
    a = rows(model.logits(docs(spark), ["doc_id"], tok()), "doc_id", "logits")
    b = rows(again.logits(docs(spark), ["doc_id"], tok(), limit=0), "doc_id", "logits")
    for (i, u), (j, v) in zip(a, b):
        assert i == j and np.allclose(u, v)
    out = {r["doc_id"]: r for r in classify.score_documents(docs(spark), ["doc_id"], model).collect()}
    joined = classify.score_documents(docs(spark), ["doc_id"], model, limit=0).collect()
    for r in joined:
        assert r["predicted_class"] == out[r["doc_id"]]["predicted_class"]
        assert r["error"] == out[r["doc_id"]]["error"] and np.allclose(r["logits"], out[r["doc_id"]]["logits"])
    assert out[9]["error"] == "text is missing" and out[9]["predicted_class"] == -1 and out[9]["logits"] == []
    assert out[2]["error"] == "text has no tokens" and out[2]["class_probabilities"] == []
    assert out[3]["predicted_class"] == 0 and abs(sum(out[3]["class_probabilities"]) - 1) < 1e-12
    assert out[5]["preprocessed_text"] == "d d c" and out[5]["text"] == "d, D c!"


def test_model_choice(spark):
    data = [(i, ["red", f"n{i % 5}"] if i % 2 else ["blue", f"n{i % 7}"], "odd" if i % 2 else "even") for i in range(60)]
    df = spark.createDataFrame(data, "id int, tokens array<string>, topic string")
    out = classify.choose_model(df.where("id < 40"), df.where("id >= 40"), "topic", classify.model_kinds(), {"features": 1024})
    assert [r["accuracy"] for r in out.collect()] == [1.0, 1.0]
    with pytest.raises(ValueError):
        classify.train_topic_model(df, "forest", "topic")


def test_runs(spark):
    runs = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.4), (3, 1, 0.4), (4, 1, None)], "id int, epoch int, val_loss double")
    assert [r["id"] for r in metrics.best_runs(runs, "val_loss", 2, "id").collect()] == [2, 3]
    assert rows(metrics.epoch_metrics(runs, "epoch", ["val_loss"]), "epoch", "steps") == [(0, 2), (1, 2)]


def test_summary_and_embedding(spark):
    df = spark.createDataFrame(
        [(1, "common common. rare words here. common.", "x"), (2, "common.", "x"), (3, "", "x")],
        "doc_id bigint, text string, lang string",
    )
    got = dict(rows(summary.extractive_summary(df, "doc_id", "text", 1), "doc_id", "summary"))
    assert got == {1: "rare words here.", 2: "common.", 3: ""}
    vecs = dict(rows(summary.doc_embedding(df, "doc_id", tok(), 8), "doc_id", "embedding"))
    assert abs(sum(x * x for x in vecs[1]) - 1) < 1e-9 and vecs[3] == [0.0] * 8


def test_both_sides_of_the_size_switch_treat_ids_alike(spark):
    given = [(1, "a b"), (1, "c c"), (None, "a"), (None, ""), (2, None)]
    df = spark.createDataFrame(given, "doc_id bigint, text string")
    words = vocab.build_vocab(docs(spark), "doc_id", tok())
    model = classify.fit_token_bayes(docs(spark), "lang", tok())
    coded = [vocab.encode(df, ["doc_id"], tok(), words, limit=n) for n in (1 << 30, 0)]
    scored = [classify.score_documents(df, ["doc_id"], model, limit=n) for n in (1 << 30, 0)]
    for small, large in (coded, scored):
        assert small.count() == len(given)
        assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect()))


def test_any_number_of_classes(spark):
    df = spark.range(1100).select(F.col("id").alias("label"), F.concat(F.lit("w"), "id").alias("text"))
    model = classify.fit_token_bayes(df, "label", tok())
    weights = {r["token"]: r["w"] for r in model.weights.collect()}
    assert len(model.classes) == len(weights) == 1100
    for i in (0, 7, 1099):
        assert weights[f"w{i}"].index(max(weights[f"w{i}"])) == i
