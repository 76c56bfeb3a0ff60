"""A store of seen keys that a batch asks without reading it whole.

Keys lie in hash buckets, one folder each. Every bucket has a Bloom filter, kept as
a table of 64-bit words: a key sets a few bits of one word, so a batch asks the
filter with one equality join. Only buckets that may hold one of the batch's keys
are opened, and only for those keys. A filter never misses a key; where it is
wrong, its bucket shows that.

Everything is appended, and adding a key twice changes nothing, so a batch that is
repeated after a failure may add its keys again. Rows carry their batch, and a
batch does not see its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.runtime import cut, folders, small_side

BUCKETS = 256
#: Keys the filters are made for; with more they still are right, but open more buckets.
CAPACITY = 10_000_000
BITS_PER_KEY = 16
# Bits a key sets in its word.
_MARKS = 5
#: The batch of keys that were there before any batch.
FIRST = -1


@dataclass
class SeenKeys:
    """The store at ``path``. ``opened`` lists the buckets the last question had to open."""

    spark: SparkSession
    path: str
    buckets: int
    words: int
    opened: list[int] = field(default_factory=list)

    @classmethod
    def open(
        cls, spark: SparkSession, path: str, buckets: int = BUCKETS, capacity: int = CAPACITY
    ) -> SeenKeys:
        """The store at ``path``, made with these parameters if there is none yet."""
        if "head" not in folders(spark, path):
            words = max(1, capacity * BITS_PER_KEY // 64 // buckets)
            head = spark.createDataFrame([(buckets, words)], "buckets int, words int")
            head.coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
        return cls(spark, path, *spark.read.parquet(f"{path}/head").first())

    def is_new(self) -> bool:
        """Whether no key was ever added."""
        return "keys" not in folders(self.spark, self.path)

    def begin(self, batch: int) -> bool:
        """Note that a batch starts; whether it started before, and may have left rows."""
        again = f"batch={batch}" in folders(self.spark, f"{self.path}/begun")
        if not again:
            mark = self.spark.createDataFrame([(batch,)], "begun long").coalesce(1)
            mark.write.mode("overwrite").parquet(f"{self.path}/begun/batch={batch}")
        return again

    def _named(self, keys: DataFrame) -> DataFrame:
        """``key, bucket, word, mask`` of every different key."""
        h, bits = F.xxhash64("key"), F.xxhash64("key", F.lit(2))
        mask: Column = F.lit(0).cast("bigint")
        for i in range(_MARKS):
            at = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
        return keys.where("key IS NOT NULL").distinct().select(
            "key",
            F.pmod(h, F.lit(self.buckets)).cast("int").alias("bucket"),
            F.pmod(F.xxhash64("key", F.lit(1)), F.lit(self.words)).cast("int").alias("word"),
            mask.alias("mask"),
        )

    def _read(self, kind: str, buckets: list[int], schema: str, batch: int) -> DataFrame:
        paths = [f"{self.path}/{kind}/bucket={b}" for b in buckets]
        rows = self.spark.read.schema(f"{schema}, batch long, bucket int")
        return rows.option("basePath", f"{self.path}/{kind}").parquet(*paths).where(F.col("batch") != batch)

    def known(self, keys: DataFrame, batch: int) -> DataFrame:
        """The keys (column ``key``) that batches other than ``batch`` have added. Written."""
        asked = cut(self._named(keys))
        there = {int(f.split("=")[1]) for f in folders(self.spark, f"{self.path}/bits") if "=" in f}
        here = sorted({r["bucket"] for r in asked.select("bucket").distinct().collect()} & there)
        self.opened = []
        if here:
            words, _ = small_side(cut(asked.select("bucket", "word").distinct()))
            bits = self._read("bits", here, "word int, bits bigint", batch)
            bits = bits.join(words, ["bucket", "word"], "left_semi")
            bits = bits.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
            full = F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")
            asked = cut(asked.join(bits, ["bucket", "word"]).where(full).select("key", "bucket"))
            self.opened = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())
        if not self.opened:
            return asked.select("key").limit(0)
        wanted, _ = small_side(asked.select("key"))
        stored = self._read("keys", self.opened, "key string", batch).select("key")
        return cut(stored.join(wanted, "key", "left_semi").distinct())

    def add(self, keys: DataFrame, batch: int) -> None:
        """Add the keys (column ``key``) of a batch; the filter first, so that it never misses one."""
        named = cut(self._named(keys).withColumn("batch", F.lit(batch).cast("long")))
        bits = named.groupBy("bucket", "word", "batch").agg(F.bit_or("mask").alias("bits"))
        for kind, rows in (("bits", bits.select("word", "bits", "batch", "bucket")),
                           ("keys", named.select("key", "batch", "bucket"))):
            rows.repartition("bucket").write.partitionBy("bucket").mode("append").parquet(f"{self.path}/{kind}")

    def compact(self, path: str, buckets: int | None = None, capacity: int | None = None) -> SeenKeys:
        """The same keys at another path, in one file a bucket, and with filters for more keys if asked."""
        capacity = capacity or self.words * 64 * self.buckets // BITS_PER_KEY
        out = SeenKeys.open(self.spark, path, buckets or self.buckets, capacity)
        if not self.is_new():
            out.add(self.spark.read.schema("key string").parquet(f"{self.path}/keys"), FIRST)
        return out
