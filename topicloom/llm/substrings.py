"""Removal of word passages that occur more than once, with suffix automata of reference shards.

A passage is ``length`` consecutive words. Every word inside a passage that also
starts anywhere else, in the same text or another, is removed; passages are
judged on the input.

Each window of ``length`` words has an anchor, its least hash of ``gram`` words,
and neighbouring windows share theirs: a text falls into pieces of windows with
one anchor. Equal windows have equal anchors, so only pieces whose anchor occurs
again can hold a repeated window, and the pieces of one anchor can be judged by
themselves. That is what makes shards of references possible without holding
every document against every shard:

* pieces of one anchor that are all equal are repeated whole, and so is every
  piece that occurs twice;
* the other pieces are the reference. They are dealt into shards by anchor; each
  shard's suffix automaton counts the occurrences of its substrings, the pieces
  stream through it, and where the matched window occurs again its words go;
* an anchor with too many different pieces for one shard is split by window:
  these are counted by hash, summed map-side.

Words are compared by 64-bit hashes, windows by the hashes of all their words
(or by one 64-bit hash of them, where pieces or split anchors are counted).

Defined results: a NULL text has no words and an empty rest; texts shorter than
a window lose nothing; repeated rows are texts of their own, so they lose all
their windows; an empty table gives an empty table; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import fresh, ref
from topicloom.llm.words import Powers, mix, rows_of_words, run_hashes, sliced, text_buffer, word_spans
from topicloom.runtime import cut, discard, small_side

LENGTH = 35
GRAM = 11
#: Words in a shard, and in the pieces of an anchor before it is split by window.
SHARD_WORDS = 100_000
SPLIT_WORDS = 50_000

_POWERS = Powers(0xDA942042E4DD58B5)


def piece_bounds(words: np.ndarray, length: int, gram: int):
    """Anchor, name, first word and number of words of every piece of a text."""
    n = len(words) - length + 1
    if n < 1:
        return None
    grams = run_hashes(words, gram)
    views = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1)
    anchor = np.arange(n) + views.argmin(axis=1)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[first, n]) + length - 1
    up, down = _POWERS.upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words) * up[:-1], out=sums[1:])
    name = mix((sums[first + size] - sums[first]) * down[first] + size.astype(np.uint64))
    return grams[anchor[first]], name, first, size


def pieces(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``anchor, name, row, start, words`` for every piece. Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            parts, owner = [], []
            for row, words in zip(batch.column("row").to_numpy(), rows_of_words(batch.column("text")), strict=True):
                got = piece_bounds(words, length, gram)
                if got is not None:
                    parts.append(got)
                    owner.append(np.full(len(got[0]), row))
            if parts:
                anchor, name, start, size = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)),
                        pa.array(name.view(np.int64)),
                        pa.array(np.concatenate(owner)),
                        pa.array(start.astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                    ],
                    names=["anchor", "name", "row", "start", "words"],
                )

    return cut(rows.mapInArrow(run, "anchor long, name long, row long, start int, words int"))


class SuffixAutomaton:
    """All substrings of a set of sequences, with the number of their occurrences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.seen = [-1], [0], [0]

    def _state(self, size: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.size.append(size)
        self.seen.append(0)
        return len(self.size) - 1

    def _split(self, p: int, q: int, x: int) -> int:
        """The state for the longest string of ``p`` and ``x``, taken out of ``q`` if that has longer ones."""
        if self.size[p] + 1 == self.size[q]:
            return q
        copy = self._state(self.size[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int], times: int) -> None:
        last = 0
        for x in sequence:
            q = self.next[last].get(x)
            if q is not None:
                last = self._split(last, q, x)
            else:
                p, last = last, self._state(self.size[last] + 1)
                while p >= 0 and x not in self.next[p]:
                    self.next[p][x] = last
                    p = self.link[p]
                self.link[last] = 0 if p < 0 else self._split(p, self.next[p][x], x)
            self.seen[last] += times

    def close(self) -> None:
        """Sum the occurrences: a string occurs wherever a longer one ends that it ends."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.seen[self.link[state]] += self.seen[state]

    def repeats(self, sequence: list[int], length: int) -> list[bool]:
        """For every window of ``length``, whether it occurs twice or more.

        Matching statistics: the state follows the longest match that ends at
        each element, and is cut back to the window.
        """
        out, state, matched = [], 0, 0
        for i, x in enumerate(sequence):
            while state and x not in self.next[state]:
                state = self.link[state]
                matched = self.size[state]
            if x in self.next[state]:
                state, matched = self.next[state][x], matched + 1
            while state and self.size[self.link[state]] >= length:
                state = self.link[state]
                matched = self.size[state]
            if i >= length - 1:
                out.append(matched >= length and self.seen[state] > 1)
        return out


def _spans(hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Word ranges that the marked windows cover."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.r_[0, gap + 1]].tolist(), (at[np.r_[gap, len(at) - 1]] + length).tolist(), strict=True))


_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_SPANS_SQL = "array<struct<lo:int,hi:int>>"


def _asked(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows that pieces are asked of, with the list of these."""
    fields = ("anchor", "name", "start", "words", "times", "split")
    lists = asked.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("asked"))
    side, _ = small_side(cut(lists))
    return rows.join(side, "row")


def _contents(rows: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """Word hashes of the asked pieces, and for split anchors the hashes of their windows. Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            lists = batch.column("asked").to_pylist()
            for words, wanted in zip(rows_of_words(batch.column("text")), lists, strict=True):
                for p in wanted:
                    part = words[p["start"] : p["start"] + p["words"]]
                    held = run_hashes(part, length) if p["split"] else part
                    out.append((p["anchor"], p["name"], p["times"], p["split"], held.view(np.int64)))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                    names=["anchor", "name", "times", "split", "held"],
                )

    schema = "anchor long, name long, times long, split boolean, held array<long>"
    return cut(_asked(rows, asked).select("text", "asked").mapInArrow(run, schema))


def _by_automaton(contents: DataFrame, length: int, shards: int) -> DataFrame:
    """``anchor, name, spans``: what goes of each reference piece, one automaton per shard."""

    def run(group: pa.Table) -> pa.Table:
        automaton = SuffixAutomaton()
        held = group.column("held").to_pylist()
        for sequence, times in zip(held, group.column("times").to_pylist(), strict=True):
            automaton.add(sequence, times)
        automaton.close()
        spans = [
            [{"lo": lo, "hi": hi} for lo, hi in _spans(np.array(automaton.repeats(s, length)), length)]
            for s in held
        ]
        return pa.table(
            {"anchor": group.column("anchor"), "name": group.column("name"), "spans": pa.array(spans, _SPANS)}
        )

    rows = contents.where(~F.col("split")).select(
        F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "anchor", "name", "times", "held"
    )
    return rows.groupBy("shard").applyInArrow(run, f"anchor long, name long, spans {_SPANS_SQL}")


def _by_window(contents: DataFrame, length: int) -> DataFrame:
    """The same for anchors split by window."""
    windows = contents.where("split").select(
        "anchor", "name", "times", F.posexplode("held").alias("at", "window")
    )
    again = windows.groupBy("anchor", "window").agg(F.sum("times").alias("n")).where("n > 1")
    hit = windows.join(again, ["anchor", "window"]).groupBy("anchor", "name")
    spans = F.transform(
        F.array_sort(F.collect_list("at")),
        lambda at: F.struct(at.cast("int").alias("lo"), (at + length).cast("int").alias("hi")),
    )
    return hit.agg(spans.alias("spans"))


def _merged(spans):
    """Sorted, overlapping and touching ranges joined."""
    start = F.struct(
        F.array().cast(_SPANS_SQL).alias("done"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi")
    )

    def step(acc, s):
        more = s["lo"] <= acc["hi"]
        closed = F.array(F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))
        return F.struct(
            F.when(more | (acc["hi"] < 0), acc["done"]).otherwise(F.concat(acc["done"], closed)).alias("done"),
            F.when(more, acc["lo"]).otherwise(s["lo"]).alias("lo"),
            F.when(more, F.greatest(acc["hi"], s["hi"])).otherwise(s["hi"]).alias("hi"),
        )

    def end(acc):
        return F.concat(acc["done"], F.array(F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi"))))

    return F.aggregate(F.sort_array(spans), start, step, end)


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``row, spans``: the word ranges to remove, for rows that lose any. Written.

    ``rows`` is a stored table of ``row`` (a number of its own) and ``text``.
    """
    found = pieces(rows, length, gram)
    stats = found.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("name").alias("lo"), F.max("name").alias("hi"), F.sum("words").alias("all")
    )
    stats = cut(stats.where("n > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("equal")))
    again = cut(found.join(stats, "anchor"))
    discard(found)
    mixed = again.where(~F.col("equal"))
    asked = mixed.groupBy("anchor", "name").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "start", "words")).alias("one")
    )
    asked = cut(asked.select("anchor", "name", "times", "one.*"))
    load = asked.groupBy("anchor").agg(F.sum("words").alias("load"))
    heavy, _ = small_side(cut(load.where(F.col("load") > SPLIT_WORDS).select("anchor", F.lit(True).alias("h"))))
    asked = asked.join(heavy, "anchor", "left").withColumn("split", F.col("h").isNotNull())
    total = asked.where(~F.col("split")).agg(F.sum("words")).first()[0] or 0
    contents = _contents(rows, asked, length)
    part = _by_automaton(contents, length, int(total // SHARD_WORDS) + 1)
    part = cut(part.unionByName(_by_window(contents, length)).where(F.size("spans") > 0))
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.col("words").alias("hi")))
    spans = again.where("equal").withColumn("spans", whole).unionByName(
        mixed.join(part, ["anchor", "name"]), allowMissingColumns=True
    )
    spans = spans.select("row", "start", F.explode("spans").alias("s")).select(
        "row", F.struct((F.col("start") + F.col("s.lo")).alias("lo"), (F.col("start") + F.col("s.hi")).alias("hi")).alias("s")
    )
    return cut(spans.groupBy("row").agg(_merged(F.collect_list("s")).alias("spans")))


def remove_repeats(docs: DataFrame, row: str, text: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``n_words``, ``removed`` (word ranges) and ``kept`` (the other words, joined by one space)."""
    rows = docs.select(ref(row).alias("row"), ref(text).alias("text"))
    spans, _ = small_side(repeated_spans(rows, length, gram))
    names = {c: fresh(docs, c) for c in ("n_words", "removed", "kept", "_spans")}
    held = names["_spans"]
    joined = docs.join(spans.select(F.col("row").alias(held + "row"), F.col("spans").alias(held)),
                       ref(row) == F.col(held + "row"), "left").drop(held + "row")

    given = docs.columns
    made = [names["n_words"], names["removed"], names["kept"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, offsets = text_buffer(batch.column(text))
            starts, ends = word_spans(data, offsets)
            at = np.searchsorted(starts, offsets)
            raw = data.tobytes()
            count, removed, kept = [], [], []
            for i, gone in enumerate(batch.column(held).to_pylist()):
                first, last = int(at[i]), int(at[i + 1])
                stays = np.ones(last - first, bool)
                for s in gone or ():
                    stays[s["lo"] : s["hi"]] = False
                b, e = starts[first:last][stays].tolist(), ends[first:last][stays].tolist()
                kept.append(b" ".join([raw[x:y] for x, y in zip(b, e, strict=True)]).decode())
                count.append(last - first)
                removed.append(gone or [])
            columns = [batch.column(c) for c in given]
            columns += [pa.array(count, pa.int64()), pa.array(removed, _SPANS), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*given, *made])

    more = f"`{made[0]}` long, `{made[1]}` {_SPANS_SQL}, `{made[2]}` string"
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(more).fields])
    return joined.mapInArrow(run, schema)
