"""The store of seen keys: exact, and opened only where a key may be."""

from pyspark.sql import functions as F

from topicloom.plans.queries import SITE, _hub
from topicloom.streaming import jobs
from topicloom.streaming.seen import SeenKeys


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def found(store, spark, names, batch=99):
    return sorted(r.key for r in store.known(keys(spark, names), batch).collect())


def test_seen_keys_are_exact(spark, tmp_path):
    store = SeenKeys.open(spark, str(tmp_path / "seen"), buckets=8, capacity=64)
    assert store.is_new() and found(store, spark, ["a"]) == []
    store.add(keys(spark, [f"u{i}" for i in range(300)] + [None, "u1"]), 0)
    store.add(keys(spark, [f"v{i}" for i in range(300)]), 1)
    asked = [f"u{i}" for i in range(250, 350)] + [f"v{i}" for i in range(5)] + [None, "w"]
    want = sorted([f"u{i}" for i in range(250, 300)] + [f"v{i}" for i in range(5)])
    # Five times as many keys as the filters are made for: still right.
    assert found(store, spark, asked) == want
    assert found(store, spark, asked, batch=1) == [k for k in want if k[0] == "u"]
    again = SeenKeys.open(spark, store.path, buckets=3)
    assert (again.buckets, again.words) == (store.buckets, store.words)
    wider = store.compact(str(tmp_path / "wide"), buckets=16, capacity=10_000)
    assert wider.buckets == 16 and found(wider, spark, asked) == want
    assert found(wider, spark, []) == [] and wider.opened == []


def test_a_batch_reads_only_its_buckets(spark, tmp_path, monkeypatch):
    store = SeenKeys.open(spark, str(tmp_path / "seen"), buckets=64, capacity=100_000)
    store.add(keys(spark, [f"https://site.example/{i}" for i in range(2000)]), 0)
    read = []
    original = SeenKeys._read

    def note(self, kind, buckets, *rest):
        rows = original(self, kind, buckets, *rest)
        read.append((kind, {f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}))
        return rows

    monkeypatch.setattr(SeenKeys, "_read", note)
    assert found(store, spark, [f"https://site.example/new/{i}" for i in range(40)]) == []
    assert [k for k, _ in read] == ["bits"] or len(read[1][1]) <= 2  # a false alarm of the filter
    read.clear()
    one = "https://site.example/17"
    assert found(store, spark, [one, "https://site.example/new/a"]) == [one]
    kinds = dict(read)
    assert len(kinds["bits"]) <= 2 and len(kinds["keys"]) == len(store.opened) <= 2


def test_begin_tells_a_repeated_batch(spark, tmp_path):
    store = SeenKeys.open(spark, str(tmp_path / "seen"), buckets=2)
    assert [store.begin(b) for b in (0, 1, 0, 1, 2)] == [False, False, True, True, False]


def test_a_repeated_batch_adds_nothing_twice(spark, sf, tmp_path, monkeypatch):
    """The job fails after its articles are stored and before the batch is done."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    drops, store, progress = (str(tmp_path / n) for n in ("drops", "store", "progress"))
    pages.where("page_id < 10").union(pages.where("page_id < 10")).write.parquet(drops)
    original = SeenKeys.add
    failing = [True]

    def add(self, rows, batch):
        if batch >= 0 and failing:
            failing.clear()
            raise RuntimeError("lost")
        original(self, rows, batch)

    monkeypatch.setattr(SeenKeys, "add", add)

    def run():
        stream = jobs.file_stream(spark, drops)
        job = jobs.ingest(stream, store, progress, _hub(), SITE, buckets=4)
        try:
            job.awaitTermination()
        except Exception as error:  # the planned one
            assert "lost" in str(error)
        return spark.read.parquet(store).count()

    assert run() == 10 and not failing
    assert run() == 10
    pages.write.mode("append").parquet(drops)
    assert run() == pages.count()
    # A store without its list of seen URLs is read once.
    other = str(tmp_path / "progress2")
    stream = jobs.file_stream(spark, drops)
    jobs.ingest(stream, store, other, _hub(), SITE, seen=str(tmp_path / "new-seen")).awaitTermination()
    assert spark.read.parquet(store).select("url").distinct().count() == spark.read.parquet(store).count() == pages.count()
    assert spark.read.parquet(store).agg(F.count("url")).first()[0] == pages.count()
