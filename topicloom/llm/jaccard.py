"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word n-grams, as 64-bit hashes; a shorter
text is one n-gram, a text without words is the empty set and matches nothing.
Documents with equal sets are merged first, so thousands of copies are one row.

All sets are sorted in one order: by hash, but with the n-grams that many
documents share at the end, rarest first. Each task reports the n-grams that
recur in its documents; the most frequent of them, of a fixed number, are that
tail. The order never changes the result, only the work.

Of two sets similar enough, the l-prefixes (all but the last ``ceil(t * size)``
n-grams, and ``l`` more) share at least ``l`` n-grams, for every ``l``. Every
document publishes its longest prefix. From the counts of its n-grams the cost
of each ``l`` is estimated, probing and verifying, and the document probes with
its cheapest one: where short prefixes meet many others, a longer prefix is
used and as many more shared n-grams are asked for before a pair is verified.

An n-gram that many prefixes hold is not joined into pairs. Its documents are
dealt by size and hash into blocks of bounded weight, each two blocks that can
hold similar sizes meet in a task of their own, and only links that connect
something new within the task come out of it.

Sets are long, so they travel last. A set's sketch is the parity of its n-grams
by some low bits of their hashes, about a bit for each; two sketches differ in no
more bits than their sets in n-grams, so a pair that differs in too many is not
similar, whatever its sets hold. Pairs and blocks are judged by sketches first,
and only what remains is verified by sets. Before blocks meet, the documents of a
crowded n-gram are compared with the first of their size; those that links have
brought together by then need not meet again. Pairs are made and verified in
rounds of bounded size, each of which leaves only its links on disk.

Defined results: a NULL text is empty; repeated rows are copies; rows with a
NULL id come after all others in their group; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import ref
from topicloom.llm.components import components
from topicloom.llm.words import rows_of_words, run_hashes, sliced
from topicloom.runtime import cut, discard, small_side

#: Most shared n-grams that a document may ask for.
MATCHES = 4
#: Cost of verifying a pair, in index entries read.
VERIFY_COST = 8.0
#: Documents with one n-gram in their prefixes that are still joined as pairs.
PAIR_LIMIT = 64
#: N-grams at the end of the order; how many a task counts at a time, and reports of these at most.
TAIL = 1 << 17
COUNTED = 1 << 22
REPORTED = 1 << 15
#: Rows of pairs that are made in a round, at least; and n-grams of pairs that are verified in one.
PAIR_ROWS = 1 << 25
PAIR_WEIGHT = 1 << 27
#: Weight of a block: n-grams, and this many more for each document.
BLOCK_WEIGHT, DOC_WEIGHT = 200_000, 64
_STEP = 1.05
_SLICE = 4096
_TILE_WORDS = 1 << 20


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    if not len(words):
        return words
    return np.unique(run_hashes(words, min(n, len(words))))


def _name(tokens: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set."""
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return tuple(np.frombuffer(digest, np.int64).tolist())


def _least(size: int, num: int, den: int) -> int:
    """What a set of this size shares at least with any set similar enough."""
    return -(-num * size // den)


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """The parity of a set's n-grams by their low bits: 64 bits at least, and one for every n-gram at least."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length()) if len(tokens) else 64
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set in fewer words, which are to be unsigned: numpy counts the bits of absolute values."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    for words in rows_of_words(batch.column("text"), lower=True):
        yield shingle_set(words, n)


def profiles(rows: DataFrame, n: int) -> DataFrame:
    """Of every ``row, text``: the size, name and sketch of its set; and n-grams that recur in a task. Written.

    ``kind`` 0 is a document (``row, n, a, b, sketch``), 1 an n-gram (``a``) with the
    number of a task's documents that have it (``n``).
    """

    names = ["kind", "row", "n", "a", "b", "sketch"]
    words = pa.list_(pa.int64())

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, count = np.unique(np.concatenate(held), return_counts=True)
        tokens, count = tokens[count > 1], count[count > 1]
        top = np.argsort(-count, kind="stable")[:REPORTED]
        none = np.zeros(len(top), np.int64)
        cols = [none + 1, none - 1, count[top], tokens[top].view(np.int64), none]
        cols = [*[pa.array(c, pa.int64()) for c in cols], pa.nulls(len(top), words)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in sliced(batches):
            out, sketches = [], []
            for row, tokens in zip(batch.column("row").to_pylist(), _sets(batch, n), strict=True):
                held.append(tokens)
                total += len(tokens)
                out.append((0, row, len(tokens), *(_name(tokens) if len(tokens) else (row, 0))))
                sketches.append(_sketch(tokens))
            cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sketches, words)], names=names)
            if total > COUNTED:
                yield often(held)
                held, total = [], 0
        if held:
            yield often(held)

    return cut(rows.select("row", "text").mapInArrow(run, "kind long, row long, n long, a long, b long, sketch array<long>"))


def _tail(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, sorted by hash, and their places in the order. At most ``TAIL``."""
    often = profile.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n"))
    got = often.orderBy(F.desc("n"), "a").limit(TAIL).collect()
    tokens = np.array([r["a"] for r in got], np.int64).view(np.uint64)
    place = np.arange(len(got), 0, -1)
    by_hash = np.argsort(tokens)
    return tokens[by_hash], place[by_hash]


def _ordered(tokens: np.ndarray, tail: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A set in the common order."""
    if not len(tail) or not len(tokens):
        return tokens
    at = np.minimum(np.searchsorted(tail, tokens), len(tail) - 1)
    late = tail[at] == tokens
    last = tokens[late]
    return np.concatenate([tokens[~late], last[np.argsort(place[at[late]])]])


def prefixes(rows: DataFrame, n: int, num: int, den: int, tail) -> DataFrame:
    """``token, row, n, level``: an n-gram is in the l-prefix for every ``l`` from ``level`` on. Written."""
    sent = rows.sparkSession.sparkContext.broadcast(tail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column("row").to_numpy()
            token, row, size, level = [], [], [], []
            for i, tokens in zip(ids, _sets(batch, n), strict=True):
                if not len(tokens):
                    continue
                first = len(tokens) - _least(len(tokens), num, den) + 1
                part = _ordered(tokens, *sent.value)[: first + MATCHES - 1]
                token.append(part)
                row.append(np.full(len(part), i))
                size.append(np.full(len(part), len(tokens)))
                level.append(np.maximum(np.arange(len(part)) - first + 2, 1))
            if token:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(token).view(np.int64)),
                        pa.array(np.concatenate(row)),
                        pa.array(np.concatenate(size).astype(np.int32)),
                        pa.array(np.concatenate(level).astype(np.int8)),
                    ],
                    names=["token", "row", "n", "level"],
                )

    return cut(rows.select("row", "text").mapInArrow(run, "token long, row long, n int, level byte"))


def _sets_of(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``row, n, tokens`` of the wanted rows. Written."""
    side, _ = small_side(cut(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [s.view(np.int64) for s in _sets(batch, n)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(sets, pa.list_(pa.int64())),
                ],
                names=["row", "n", "tokens"],
            )

    needed = rows.select("row", "text").join(side, "row", "left_semi")
    return cut(needed.mapInArrow(run, "row long, n int, tokens array<long>"))


def _similar(both: Column, x: Column, y: Column, num: int, den: int) -> Column:
    return den * both >= num * (x + y - both)


def _part(col: str, parts: int, part: int) -> Column:
    """The rows of one of so many rounds."""
    return F.pmod(F.xxhash64(col, F.lit(parts)), F.lit(parts)) == part


def _candidate_pairs(light: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that share as many prefix n-grams as the larger document asks for, and may be similar: ``x, y, n``. Written."""
    light = light.select("token", "row", "n", "level", "df")
    most = light.agg(F.sum(F.col("df") - 1), F.count(F.lit(1))).first()
    parts = max(1, -(-(most[0] or 0) // (2 * max(PAIR_ROWS, 4 * most[1]))))
    out = None
    for part in range(parts):
        pairs = _near(_shared_pairs(light, num, den, parts, part), sketches, num, den)
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _shared_pairs(light: DataFrame, num: int, den: int, parts: int, part: int) -> DataFrame:
    """The pairs of one round."""
    probe = light.where(_part("row", parts, part)) if parts > 1 else light
    costs = probe.groupBy("row").agg(
        F.first("n").alias("size"),
        *[
            F.sum(F.when(F.col("level") <= m, F.col("df") - 1).otherwise(0)).alias(f"c{m}")
            for m in range(1, MATCHES + 1)
        ],
    )
    least = F.ceil(F.col("size") * num / den)
    options = [
        F.when(
            F.lit(m) <= least,
            F.struct((F.col(f"c{m}") * (1 + VERIFY_COST / m**2)).alias("cost"), F.lit(m).alias("asked")),
        )
        for m in range(1, MATCHES + 1)
    ]
    asked = costs.select("row", F.array_min(F.array_compact(F.array(*options)))["asked"].alias("asked"))
    probe = probe.join(asked, "row").where(F.col("level") <= F.col("asked"))
    probe = probe.select("token", F.col("row").alias("x"), F.col("n").alias("nx"), "asked")
    index = light.select("token", F.col("row").alias("y"), F.col("n").alias("ny"), "level")
    before = F.struct("ny", "y") < F.struct("nx", "x")
    met = probe.join(index, "token").where(
        before & (F.col("level") <= F.col("asked")) & (den * F.col("ny") >= num * F.col("nx"))
    )
    shared = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"), F.first("asked").alias("asked"))
    return shared.where(F.col("shared") >= F.col("asked")).select("x", "y")


def _near(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sketches allow that they are similar: ``x, y, n``, with the size of both. Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("nx").to_numpy() + batch.column("ny").to_numpy()
            sides = [batch.column(c) for c in ("sx", "sy")]
            (vx, ax), (vy, ay) = ((c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in sides)
            kept = np.zeros(batch.num_rows, bool)
            for i, size in enumerate(sizes):
                x, y = vx[ax[i] : ax[i + 1]], vy[ay[i] : ay[i + 1]]
                words = min(len(x), len(y))
                differ = int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum())
                kept[i] = (den + num) * differ <= (den - num) * size
            got = batch.filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [got.column("x"), got.column("y"), pa.array(sizes[kept])], names=["x", "y", "n"]
            )

    x, y = (sketches.select(F.col("row").alias(c), F.col("n").alias("n" + c), F.col("sketch").alias("s" + c)) for c in "xy")
    both = pairs.join(x, "x").join(y, "y").select("x", "y", "nx", "ny", "sx", "sy")
    return cut(both.mapInArrow(run, "x long, y long, n long"))


def _verified(rows: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs whose sets are similar: ``x, y``. Written in rounds, so that few sets lie on disk at a time."""
    weight = pairs.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-weight // PAIR_WEIGHT))
    out = None
    for part in range(parts):
        here = pairs.where(_part("x", parts, part)).select("x", "y")
        wanted = here.select(F.col("x").alias("row")).unionByName(here.select(F.col("y").alias("row")))
        sets = _sets_of(rows, wanted.distinct(), n)
        one = sets.select(F.col("row").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
        two = sets.select(F.col("row").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
        both = F.size(F.array_intersect("tx", "ty"))
        near = here.join(one, "x").join(two, "y").where(_similar(both, F.col("nx"), F.col("ny"), num, den))
        near = cut(near.select("x", "y"))
        discard(sets)
        out = near if out is None else out.unionByName(near)
    return out


def _by_head(dense: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Documents of crowded n-grams with the first of their size there, if they may be similar: ``x, y, n``. Written."""
    head = F.min("row").over(Window.partitionBy("token", _band()))
    pairs = dense.select("row", "n", "token").withColumn("x", head).where("x <> row")
    return _near(pairs.select("x", F.col("row").alias("y")).distinct(), sketches, num, den)


def _band() -> Column:
    """The band of sizes that a document of ``n`` n-grams is in."""
    return F.floor(F.log(F.col("n").cast("double")) / float(np.log(_STEP))).cast("int")


def _cells(dense: DataFrame, num: int, den: int) -> DataFrame:
    """``cell, side, row`` for the documents of crowded n-grams: every two blocks that can match."""
    dense = dense.select("token", "row", "n", _band().alias("band"))
    reach = int(np.ceil(np.log(den / num) / np.log(_STEP))) + 1
    bands = dense.groupBy("token", "band").agg(F.sum(F.col("n") + DOC_WEIGHT).alias("weight"))
    bands = bands.withColumn("parts", F.ceil(F.col("weight") / BLOCK_WEIGHT).cast("int"))
    blocks = cut(
        bands.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("token", "band", "part", "parts")
    )
    left = blocks.select("token", *[F.col(c).alias("l_" + c) for c in ("band", "part")])
    right = blocks.select("token", *[F.col(c).alias("r_" + c) for c in ("band", "part")])
    met = left.join(right, "token").where(
        (F.struct("l_band", "l_part") <= F.struct("r_band", "r_part"))
        & (F.col("r_band") - F.col("l_band") <= reach)
    )
    met = met.withColumn("cell", F.xxhash64("token", "l_band", "l_part", "r_band", "r_part"))
    alone = F.struct("l_band", "l_part") == F.struct("r_band", "r_part")
    sides = met.select("token", "cell", F.lit(0).alias("side"), F.col("l_band").alias("band"), F.col("l_part").alias("part"))
    sides = sides.unionByName(
        met.where(~alone).select(
            "token", "cell", F.lit(1).alias("side"), F.col("r_band").alias("band"), F.col("r_part").alias("part")
        )
    )
    parts = bands.select("token", "band", "parts")
    placed = dense.join(parts, ["token", "band"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))
    return placed.join(sides, ["token", "band", "part"]).select("cell", "side", "row")


class _Groups:
    """Union by least number, for the rows of one task."""

    def __init__(self):
        self._up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self._up
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self._up[max(x, y)] = min(x, y)
        return x != y


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every left with every right set, a slice of n-grams at a time."""
    owner_l = np.repeat(np.arange(len(left)), [len(s) for s in left])
    owner_r = np.repeat(np.arange(len(right)), [len(s) for s in right])
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    known = np.intersect1d(flat_l, flat_r)
    out = np.zeros((len(left), len(right)), np.float32)

    def places(flat, owner):
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = known[at] == flat
        at, owner = at[hit], owner[hit]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order]

    if not len(known):
        return out
    at_l, own_l = places(flat_l, owner_l)
    at_r, own_r = places(flat_r, owner_r)
    for first in range(0, len(known), _SLICE):
        width = min(_SLICE, len(known) - first)
        mats = []
        for at, own, size in ((at_l, own_l, len(left)), (at_r, own_r, len(right))):
            lo, hi = np.searchsorted(at, [first, first + width])
            m = np.zeros((size, width), np.float32)
            m[own[lo:hi], at[lo:hi] - first] = 1
            mats.append(m)
        out += mats[0] @ mats[1].T
    return out


def _near_in_cells(cells: DataFrame, sketches: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """``cell, side, row, n`` of the rows that may be similar to one across, but are not linked to it yet. Written."""

    def run(group: pa.Table) -> pa.Table:
        side, size = group.column("side").to_numpy(), group.column("n").to_numpy()
        root = group.column("root").to_numpy()
        sketch = group.column("sketch").combine_chunks()
        values, at = sketch.values.to_numpy().view(np.uint64), sketch.offsets.to_numpy()
        words = int(np.diff(at).min())
        flat = np.array([_folded(values[at[i] : at[i + 1]], words) for i in range(len(side))])
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(r):
            r = l
        near = np.zeros(len(side), bool)
        step = max(1, _TILE_WORDS // max(1, len(r) * words))
        for first in range(0, len(l), step):
            part = l[first : first + step]
            differ = np.bitwise_count(flat[part][:, None, :] ^ flat[r][None, :, :]).sum(axis=2, dtype=np.int64)
            may = (den + num) * differ <= (den - num) * (size[part][:, None] + size[r][None, :])
            may &= root[part][:, None] != root[r][None, :]
            near[part[may.any(axis=1)]] = True
            near[r[may.any(axis=0)]] = True
        return group.select(["cell", "side", "row", "n"]).filter(pa.array(near))

    rows = cells.join(sketches.select("row", "n", "sketch"), "row")
    rows = rows.join(groups.select(F.col("node").alias("row"), "root"), "row", "left")
    rows = rows.withColumn("root", F.coalesce("root", "row"))
    return cut(rows.groupBy("cell").applyInArrow(run, "cell long, side int, row long, n long"))


def _links_in_cells(cells: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links among the documents of each cell, as many as connect them."""

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        row = group.column("row").to_numpy()
        tokens = group.column("tokens").combine_chunks()
        values, at = tokens.values.to_numpy(), tokens.offsets.to_numpy()
        sets_ = [values[at[i] : at[i + 1]] for i in range(len(row))]
        size = np.diff(at)
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(r):
            r = l
        x, y = [], []
        if len(l):
            both = _shared_counts([sets_[i] for i in l], [sets_[i] for i in r])
            union = size[l][:, None] + size[r][None, :] - both
            known = _Groups()
            for i, j in np.argwhere(den * both >= num * union).tolist():
                a, b = int(row[l[i]]), int(row[r[j]])
                if a != b and known.join(a, b):
                    x.append(a)
                    y.append(b)
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    rows = cells.join(sets.select("row", "tokens"), "row")
    return rows.groupBy("cell").applyInArrow(run, "x long, y long")


def links(rows: DataFrame, reps: DataFrame, profile: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links between representatives that connect all similar ones: ``x, y``. Written."""
    index = prefixes(reps, n, num, den, _tail(profile))
    df = index.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    df, _ = small_side(cut(df))
    met = cut(index.join(df, "token"))
    discard(index)
    sketches = profile.where("kind = 0").select("row", "n", "sketch")
    pairs = _candidate_pairs(met.where(F.col("df") <= PAIR_LIMIT), sketches, num, den)
    dense = met.where(F.col("df") > PAIR_LIMIT)
    crowded = bool(dense.take(1))
    if crowded:
        pairs = cut(pairs.unionByName(_by_head(dense, sketches, num, den)).distinct())
    found = _verified(rows, pairs, n, num, den)
    if not crowded:
        return found
    cells = cut(_cells(dense, num, den))
    discard(met)
    near = _near_in_cells(cells, sketches, components(found, "x", "y"), num, den)
    discard(cells)
    weight = near.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-weight // PAIR_WEIGHT))
    for part in range(parts):
        here = near.where(_part("cell", parts, part))
        sets = _sets_of(rows, here.select("row").distinct(), n)
        found = found.unionByName(cut(_links_in_cells(here, sets, num, den)))
        discard(sets)
    return found


def similar_groups(
    docs: DataFrame, row: str, doc_id: str, text: str, n: int = 5, num: int = 8, den: int = 10
) -> DataFrame:
    """Per row: ``row, doc_id, n_shingles, component_id, first``.

    Documents are linked when ``den`` times their sets' intersection is at least
    ``num`` times the union. ``component_id`` is the least id that links lead
    to, ``first`` marks one row of each group, that with the least id.
    ``row`` is a number of its own in each row of a stored table.
    """
    rows = docs.select(ref(row).alias("row"), ref(doc_id).alias("doc_id"), ref(text).alias("text"))
    profile = profiles(rows, n)
    named = profile.where("kind = 0").select("row", F.col("n").alias("n_shingles"), "a", "b")
    named = cut(rows.select("row", "doc_id").join(named, "row"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = cut(
        named.groupBy("a", "b").agg(
            F.min(place).alias("least"), F.count(F.lit(1)).alias("copies")
        )
    ).withColumn("rep", F.col("least.row"))
    copied = classes.where("copies > 1").select("a", "b", "rep")
    copied, _ = small_side(cut(copied))
    others = named.join(copied, ["a", "b"]).where(F.col("row") != F.col("rep")).select("row")
    others, _ = small_side(cut(others))
    reps = rows.join(others, "row", "left_anti")
    groups = components(links(rows, reps, profile, n, num, den), "x", "y")
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    grouped = groups.join(classes.select(F.col("rep").alias("node"), "a", "b", "least"), "node")
    grouped = cut(grouped)
    least = grouped.groupBy("root").agg(F.min("least").alias("group_least"))
    grouped, _ = small_side(cut(grouped.join(least, "root").select("a", "b", "group_least")))
    own, _ = small_side(cut(classes.where("copies > 1").select("a", "b", "least")))
    out = named.join(grouped, ["a", "b"], "left").join(own, ["a", "b"], "left")
    first = F.coalesce("group_least", "least", place)
    return out.select(
        "row", "doc_id", "n_shingles",
        first["doc_id"].alias("component_id"),
        (first["row"] == F.col("row")).alias("first"),
    )
