"""Words of whole texts: the column form and the vectorised hashes of Arrow batches.

A word is a longest run of code points other than space, tab, line feed,
vertical tab, form feed and carriage return: ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]"

_CHUNK = 1 << 19
_MASK = (1 << 64) - 1


def count_words(text: Column) -> Column:
    """Words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look random (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWER = np.arange(256)
_LOWER[65:91] += 32


class Powers:
    """``base ** i`` and ``base ** -i`` modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self._base, self._back = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self._up) <= n:
            size = len(self._up)
            up, down = pow(self._base, size, 1 << 64), pow(self._back, size, 1 << 64)
            self._up = np.concatenate([self._up, self._up * np.uint64(up)])
            self._down = np.concatenate([self._down, self._down * np.uint64(down)])
        return self._up[:n], self._down[:n]


_BYTE_POWERS = Powers(0xD1342543DE82EF95)
_WORD_POWERS = Powers(0xAF251AF3B0F025B5)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its rows; NULL is empty."""
    texts = pa.array(texts.to_pylist(), pa.large_string()) if texts.null_count else texts
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return data[first:last], offsets - first


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word and the byte after it. Words end where their row ends."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD_BYTE[data]
    here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1


def word_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False
) -> np.ndarray:
    """A 64-bit hash of every word, in pieces of bounded size."""
    table = _BYTES[_LOWER] if lower else _BYTES
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        stop = max(int(np.searchsorted(ends, first + _CHUNK, "right")), at + 1)
        last = int(ends[stop - 1])
        up, down = _BYTE_POWERS.upto(last - first + 1)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(table[data[first:last]] * up[: last - first], out=sums[1:])
        s, e = starts[at:stop] - first, ends[at:stop] - first
        out[at:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _ODD)
        at = stop
    return out


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` consecutive words of one text."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    if n <= 4:
        sums = np.zeros(len(words) - n + 1, np.uint64)
        for j in range(n):
            sums = sums * np.uint64(0x9FB21C651E98DF25) + words[j : len(words) - n + 1 + j]
        return mix(sums + np.uint64(n))
    up, down = _WORD_POWERS.upto(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    at = len(words) - n + 1
    return mix((sums[n:] - sums[:at]) * down[:at] + np.uint64(n))


def rows_of_words(texts: pa.Array, lower: bool = False) -> Iterator[np.ndarray]:
    """The word hashes of every row of a batch, in order."""
    data, offsets = text_buffer(texts)
    starts, ends = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends, lower)
    at = np.searchsorted(starts, offsets)
    for i in range(len(offsets) - 1):
        yield hashes[at[i] : at[i + 1]]


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that what is made of few texts is held at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
