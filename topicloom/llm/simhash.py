"""SimHash near-duplicates by covering locality-sensitive hashing, without missed or unwanted links.

A fingerprint has a bit set where over half the hashes of a text's shingles,
repeats included, have it set. Two texts are linked when their fingerprints
differ in at most ``RADIUS`` bits.

Every bit position is given a nonzero vector of ``RADIUS + 1`` bits; a table
belongs to each nonzero vector ``v`` and keeps the positions whose vector has an
odd product with ``v``. For any ``RADIUS`` positions there is a ``v`` orthogonal
to all of their vectors, so fingerprints that differ just there are equal under
that table's mask: every pair within the radius collides in some table. With 64
bits and seven tables a mask keeps 36 or 37 bits, which strangers rarely share.

Equal fingerprints are one row before that, however many texts have them. In a
bucket of up to ``PAIR_LIMIT`` different fingerprints pairs are compared. A more
crowded one is linked without pairs: two fingerprints differ in at most two bits
exactly if some value is at most one bit from both, so each member names itself
and its neighbours on the bits the table left out, and all who name a value are
linked to the least of them. This is exact too, and grows with the members.

Defined results: A-Z are lower-cased, words are runs of other than ASCII space;
a text of fewer words than a shingle is one shingle; one without words, or NULL,
has fingerprint zero and is linked like any other; ``component_id`` is the least
id of the rows that links lead to, NULL if none of them has an id; repeated ids
are rows of their own; an empty table gives an empty table; other columns stay
as they are, columns with the names of the results are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import fresh, ref
from topicloom.llm.components import components
from topicloom.operators.joins import lookup_join
from topicloom.runtime import cut

BITS = 64
RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
#: Different fingerprints that a bucket may hold before it is linked by neighbours instead of pairs.
PAIR_LIMIT = 32

# Hashes that are counted together; a byte holds a count of at most 255.
_LANE = 255
# Words whose hashes are in memory together.
_PIECE_WORDS = 1 << 17
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The bit mask of every table; each pair within the radius is equal under one of them."""
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << i for i in range(bits) if ((i % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shingles(text: str | None, n: int) -> Iterator[bytes]:
    """The shingles of one text, repeats included."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return
    line = b" ".join(words)
    if len(words) <= n:
        yield line
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: len(words) - n + 1].tolist()
    for first, last in zip(starts, ends[n - 1 :].tolist(), strict=True):
        yield line[first:last]


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text, the bits set in over half of its hashes. ``sizes`` are positive."""
    # Lanes of at most 255 hashes never cross a text; the counts of its lanes are added.
    lanes = -(-sizes // _LANE)
    text = np.repeat(np.arange(len(sizes)), lanes)
    first_lane = np.cumsum(lanes) - lanes
    starts = (np.cumsum(sizes) - sizes)[text] + (np.arange(len(text)) - first_lane[text]) * _LANE
    ones = np.uint64(0x0101010101010101)
    out = np.zeros(len(sizes), np.uint64)
    for bit in range(8):
        counts = np.add.reduceat((hashes >> np.uint64(bit)) & ones, starts)
        by_byte = counts.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(by_byte, first_lane, axis=0)
        over = (2 * total > sizes[:, None]).astype(np.uint64)
        out |= (over << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return out


def _long_majority(text: str, n: int) -> np.uint64:
    """The same of one long text, some hashes at a time."""
    hash64 = partial(xxhash.xxh64_intdigest, seed=SEED)
    seen, total = 0, np.zeros(BITS, np.int64)
    shingles = _shingles(text, n)
    while True:
        part = np.fromiter((hash64(s) for _, s in zip(range(_PIECE_WORDS), shingles, strict=False)), np.uint64)
        if not len(part):
            break
        seen += len(part)
        for bit in range(BITS):
            total[bit] += int(((part >> np.uint64(bit)) & np.uint64(1)).sum())
    return np.uint64(sum(1 << bit for bit in range(BITS) if 2 * total[bit] > seen))


def fingerprint(texts: list[str | None], n: int = SHINGLE_WORDS) -> np.ndarray:
    """The fingerprint of every text, as unsigned 64-bit numbers."""
    hash64 = partial(xxhash.xxh64_intdigest, seed=SEED)
    out = np.zeros(len(texts), np.uint64)
    held, sizes, rows = [], [], []

    def count() -> None:
        if rows:
            hashes = np.fromiter(held, np.uint64, len(held))
            out[rows] = _majority(hashes, np.array(sizes))
        held.clear()
        sizes.clear()
        rows.clear()

    for row, text in enumerate(texts):
        if text is not None and len(text) > 8 * _PIECE_WORDS:
            out[row] = _long_majority(text, n)
            continue
        before = len(held)
        held.extend(map(hash64, _shingles(text, n)))
        if len(held) > before:
            rows.append(row)
            sizes.append(len(held) - before)
        if len(held) > _PIECE_WORDS:
            count()
    count()
    return out


def fingerprints(docs: DataFrame, text: str, name: str, n: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` without ``text`` and with the fingerprint ``name``, a signed long of the same bits."""
    if fresh(docs.drop(text), name) != name:
        raise ValueError(f"there is a column {name} already")
    others = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fingerprint(batch.column(text).to_pylist(), n).view(np.int64)
            kept = [batch.column(f.name) for f in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(made)], names=[*[f.name for f in others], name])

    return docs.mapInArrow(run, T.StructType([*others, T.StructField(name, T.LongType())]))


def _buckets(prints: DataFrame, radius: int) -> DataFrame:
    """``table, bucket, f, n``: the fingerprints of every bucket that holds two or more. Written."""
    tables = [
        F.struct(F.lit(i).alias("table"), F.col("f").bitwiseAND(F.lit(_signed(m))).alias("bucket"))
        for i, m in enumerate(masks(radius))
    ]
    rows = prints.select("f", F.explode(F.array(*tables)).alias("t")).select("t.table", "t.bucket", "f")
    n = rows.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut(rows.join(n, ["table", "bucket"]))


def _paired(buckets: DataFrame, radius: int) -> DataFrame:
    one, two = buckets.withColumnRenamed("f", "x"), buckets.select("table", "bucket", F.col("f").alias("y"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius
    return one.join(two, ["table", "bucket"]).where((F.col("x") < F.col("y")) & near).select("x", "y")


def _by_neighbours(buckets: DataFrame, radius: int) -> DataFrame:
    """Links that join what is at most two bits apart in a bucket: each member to the least that names a value."""
    flips = [
        F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(BITS) if not m >> i & 1])
        for m in masks(radius)
    ]
    flips = F.element_at(F.array(*flips), F.col("table") + 1)
    named = buckets.select("table", "f", F.explode(flips).alias("flip"))
    named = named.select("table", "f", F.col("f").bitwiseXOR(F.col("flip")).alias("value"))
    # A value keeps the bits of the mask, so table and value name the bucket as well.
    least = named.groupBy("table", "value").agg(F.min("f").alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = named.join(least, ["table", "value"]).where(F.col("f") != F.col("x"))
    return met.select("x", F.col("f").alias("y")).distinct()


def links(prints: DataFrame, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``x, y``: links between the different fingerprints ``f`` that connect all within the radius."""
    if radius != 2:
        raise ValueError("crowded buckets are linked by neighbours, which is exact for a radius of 2")
    buckets = _buckets(prints, radius)
    pairs = _paired(buckets.where(F.col("n") <= pair_limit), radius)
    return pairs.unionByName(_by_neighbours(buckets.where(F.col("n") > pair_limit), radius)).distinct()


def near_groups(
    docs: DataFrame, doc_id: str, text: str, fingerprint_: str = "fingerprint", component: str = "component_id"
) -> DataFrame:
    """``docs`` without ``text``, with the fingerprint (16 hex digits) and the least id of each row's group."""
    for name in (fingerprint_, component):
        if fresh(docs.drop(text), name) != name:
            raise ValueError(f"there is a column {name} already")
    f = fresh(docs, "_f")
    rows = cut(fingerprints(docs, text, f))
    prints = cut(rows.groupBy(ref(f).alias("f")).agg(F.min(ref(doc_id)).alias("least"), F.count(F.lit(1)).alias("n")))
    groups = components(links(prints.select("f")), "x", "y")
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    linked = cut(prints.join(groups.withColumnRenamed("node", "f"), "f"))
    least = linked.groupBy("root").agg(F.min("least").alias("group_least"))
    linked = linked.join(least, "root").select("f", "group_least")
    # Fingerprints of several rows or with links; all others are groups of one row.
    shared = prints.join(linked.withColumn("linked", F.lit(True)), "f", "left").where("n > 1 OR linked")
    found = shared.select(
        F.col("f").alias(f),
        F.struct(F.when(F.col("linked"), F.col("group_least")).otherwise(F.col("least")).alias("id")).alias(f + "g"),
    )
    out = lookup_join(rows, cut(found), f)
    group = ref(f + "g")
    return out.select(
        *[ref(c) for c in docs.columns if c != text],
        F.lower(F.lpad(F.hex(ref(f)), 16, "0")).alias(fingerprint_),
        F.when(group.isNotNull(), group["id"]).otherwise(ref(doc_id)).alias(component),
    )
