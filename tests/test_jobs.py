import json

from pyspark.sql import functions as F

from topicloom.operators import extract
from topicloom.plans import corpus, training
from topicloom.plans.queries import SITE, SITE_ID, _hub
from topicloom.sources import tables, vocab_json
from topicloom.streaming import jobs


def test_csv_keeps_difficult_text(spark, tmp_path):
    path = str(tmp_path / "csv")
    data = [("c", "u1", 'say "hi", ok', "line\nnext\n", "s", "a|b", "  padded ", "d"), ("c", "u2", "nan", "", "s", "a", "b", "d")]
    df = spark.createDataFrame(data, tables.ARTICLES)
    tables.write_csv(df, path)
    got = {r["url"]: r for r in tables.read_csv(spark, path).collect()}
    assert tuple(got["u1"]) == data[0]
    assert got["u2"]["title"] is None and got["u2"]["text"] is None
    raw = {r["url"]: r for r in tables.read_csv(spark, path, missing=()).collect()}
    assert raw["u2"]["title"] == "nan"


def test_vocab_json_is_one_object(spark, tmp_path):
    path = str(tmp_path / "vocab")
    v = spark.createDataFrame([("<unk>", 0), ("a", 1), (",", 2), ('"', 3), ("я\\", 4), ("}", 5)], "token string, idx bigint")
    vocab_json.write_vocab_json(v.repartition(3), path)
    files = sorted((tmp_path / "vocab").glob("part-*"))
    assert json.loads("".join(f.read_text("utf-8") for f in files)) == {r[0]: r[1] for r in v.collect()}
    assert sorted(vocab_json.read_vocab_json(spark, path).collect()) == sorted(v.collect())
    single = tmp_path / "one.json"
    single.write_text(json.dumps({"<unk>": 0, "слово": 1, "b": 2}))
    assert dict(vocab_json.read_vocab_json(spark, str(single)).collect()) == {"<unk>": 0, "слово": 1, "b": 2}


def test_category_folders(spark, tmp_path):
    path = str(tmp_path / "cat")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "category string, x int")
    tables.write_by_category(df, path)
    tables.write_by_category(df, path)
    plan = spark.read.parquet(path).where("category = 'a'")
    assert plan.count() == 2
    assert "PartitionFilters: [isnotnull(category" in plan._jdf.queryExecution().executedPlan().toString()


def test_stream_resumes_and_equals_batch(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    drops, store, progress, errors = (str(tmp_path / n) for n in ("drops", "store", "progress", "errors"))

    def run():
        stream = jobs.file_stream(spark, drops)
        jobs.ingest(stream, store, progress, _hub(), SITE, errors).awaitTermination()
        return spark.read.parquet(store).count()

    half = pages.where("page_id < 20")
    half.write.mode("append").parquet(drops)
    assert run() == 20
    assert run() == 20
    pages.write.mode("append").parquet(drops)
    assert run() == pages.count()
    assert run() == pages.count()
    want = extract.extract_articles(pages, _hub(), SITE)
    got = spark.read.parquet(store)
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0
    logged = spark.read.parquet(errors)
    assert {r["error"] for r in logged.select("error").distinct().collect()} == {"no tags", "no date"}
    assert logged.select("url").distinct().count() == pages.count()


def test_unseen_rows_are_added_once(spark, tmp_path):
    store = str(tmp_path / "store")
    df = spark.createDataFrame([("u1", 1), ("u1", 0), ("u2", 5)], "url string, x int")
    df.limit(0).write.parquet(store)
    for _ in range(2):
        jobs.unseen_in(df, store, "url", [F.col("x")]).write.mode("append").parquet(store)
    assert sorted(tuple(r) for r in spark.read.parquet(store).collect()) == [("u1", 0), ("u2", 5)]


def test_corpus_from_links(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    links = pages.select(F.lit("h2").alias("hub"), F.lit(1).alias("ord"), "url").union(
        pages.where("page_id < 5").select(F.lit("h1"), F.lit(0), "url")
    )
    store = pages.where("page_id = 0").select("url")
    got = corpus.collect_articles(links, pages, store, [F.col("ord")], SITE)
    assert got.count() == pages.count() - 1
    assert got.where("category = 'h1'").count() == 4
    twice = pages.union(pages)
    assert corpus.build_corpus(twice, _hub(), SITE, id_pattern=SITE_ID).count() == pages.count()


def test_prepare_is_independent_of_partitions(spark, sf):
    docs = training.with_targets(spark.read.parquet(f"{sf}/documents.parquet"), "lang")
    runs = [
        sorted(
            tuple(map(str, r))
            for r in training.prepare(docs.repartition(n), "doc_id", "text", "target", 50).rows.collect()
        )
        for n in (1, 7)
    ]
    assert runs[0] == runs[1]
    assert sum("val" in r for r in runs[0]) == int(0.05 * docs.count())
