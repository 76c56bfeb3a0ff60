"""Periodic runs of whole texts: maximal stretches of words that repeat with one period.

A run is a stretch of consecutive words with smallest period ``q`` that is at
least ``MIN_PERIODS`` periods and ``MIN_WORDS`` words long and that no
neighbouring word extends.

Runs are found by block convolution. At every scale ``L = 1, 2, 4, ...`` a text is
cut into blocks of ``L`` words; each block is looked for in the window that
follows it, at the distances ``L`` to ``2 L - 1``. For a block ``B`` and a window
``W`` of word numbers the mismatch at a distance is the sum of ``(B - W)**2``,
that is two sums of squares less twice a correlation, which is a product of
number-theoretic transforms modulo a prime: exact integers, no rounding. Where it
is zero the block occurs again. A run of period ``q`` in ``[L, 2 L)`` is four
periods long, so a whole block lies in its first period and again at distance
``q``: no run is missed. Every such distance seeds an extension to both sides,
word against word, which also drops the rare sum that is a multiple of the prime.

Only blocks that can match are transformed: each of their words must come again
within the reach of the scale, and so in a block beside them. Blocks whose whole window lies in a run of a
period of at most ``L / 2`` are skipped, since they recur there at multiples of
that period only, and so is a seed that a known run of a divisor explains.

Defined results: words are runs of other than ASCII space; a NULL or empty text
has no words and no runs; a repeated row gives the same result again; an empty
table gives an empty table; other columns stay as they are, and a column with
the name of the result is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from topicloom.llm.common import fresh
from topicloom.llm.words import sliced

MIN_PERIODS, MIN_WORDS = 4, 6

# A prime 15 * 2**27 + 1 and a number that generates its powers.
PRIME, ROOT = 2013265921, 31
#: Blocks up to this length are multiplied out; longer ones go through the transform.
SCHOOLBOOK = 16
#: Numbers that are transformed together.
PIECE = 1 << 17

NAMES = ("start", "length", "period")
RUN = T.StructType([T.StructField(n, T.LongType()) for n in NAMES])
FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("best", RUN),
        T.StructField("collapsed", T.StringType()),
    ]
)
_RUN = pa.struct([(n, pa.int64()) for n in NAMES])
_FIELDS = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("best", _RUN), ("collapsed", pa.string())])


@lru_cache(64)
def _powers(size: int, back: bool) -> np.ndarray:
    """The powers of a root of unity of order ``size``, half a turn."""
    w = pow(ROOT, (PRIME - 1) // size, PRIME)
    w = pow(w, -1, PRIME) if back else w
    out = np.ones(size // 2, np.uint64)
    done = 1
    while done < len(out):
        more = min(done, len(out) - done)
        out[done : done + more] = out[:more] * np.uint64(pow(w, done, PRIME)) % np.uint64(PRIME)
        done += more
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """The number-theoretic transform of every row, in bit-reversed order."""
    p = np.uint64(PRIME)
    x = rows % p
    m, size = x.shape
    half = size // 2
    while half:
        pairs = x.reshape(m, -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        out = np.empty_like(pairs)
        out[:, :, 0] = (a + b) % p
        out[:, :, 1] = (a + p - b) * _powers(2 * half, False) % p
        x = out.reshape(m, size)
        half //= 2
    return x


def inverse(rows: np.ndarray) -> np.ndarray:
    """The rows that ``transform`` makes these of."""
    p = np.uint64(PRIME)
    x = rows
    m, size = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(m, -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1] * _powers(2 * half, True) % p
        out = np.empty_like(pairs)
        out[:, :, 0] = (a + b) % p
        out[:, :, 1] = (a + p - b) % p
        x = out.reshape(m, size)
        half *= 2
    return x * np.uint64(pow(size, -1, PRIME)) % p


def _matches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Per block, where in its window (twice as wide, less one) its mismatch is zero."""
    m, size = blocks.shape
    if size <= SCHOOLBOOK:
        out = np.empty((m, size), bool)
        for j in range(size):
            off = blocks - windows[:, j : j + size]
            out[:, j] = (off * off).sum(axis=1) == 0
        return out
    p = np.uint64(PRIME)
    b, w = blocks.astype(np.uint64), windows.astype(np.uint64)
    wide = np.zeros((m, 2 * size), np.uint64)
    wide[:, : 2 * size - 1] = w
    turned = np.zeros((m, 2 * size), np.uint64)
    turned[:, :size] = b[:, ::-1]
    product = inverse(transform(wide) * transform(turned) % p)
    cross = product[:, size - 1 : 2 * size - 1]
    squares = np.zeros((m, 2 * size), np.uint64)
    np.cumsum(w * w % p, axis=1, out=squares[:, 1:])
    of_window = (squares[:, size:] - squares[:, :size]) % p
    of_block = (b * b % p).sum(axis=1) % p
    return (of_block[:, None] + of_window) % p == 2 * cross % p


def _grown(x: np.ndarray, at: int, d: int, step: int) -> int:
    """How many words from ``at`` on, in the direction of ``step``, equal the words ``d`` after them."""
    room = len(x) - d - at if step > 0 else at + 1
    done, size = 0, 64
    while done < room:
        size = min(size, room - done)
        first = at + done if step > 0 else at - done - size + 1
        off = np.flatnonzero(x[first : first + size] != x[first + d : first + d + size])
        if len(off):
            return done + int(off[0] if step > 0 else size - 1 - off[-1])
        done += size
        size *= 2
    return done


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run of a sequence of word numbers below its length, in order."""
    n = len(x)
    if n < MIN_WORDS:
        return []
    order = np.argsort(x, kind="stable")
    again = np.full(n, n, np.int64)
    same = x[order[1:]] == x[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    found: list[tuple[int, int, int]] = []
    size = 1
    while MIN_PERIODS * size <= n:
        starts = np.arange(0, n - 2 * size + 1, size)
        able = np.maximum.reduceat(again[: starts[-1] + size], starts) < 2 * size
        # Equal to what follows at one distance for three periods, so for two blocks in a row.
        beside = np.zeros(len(able) + 2, bool)
        beside[1:-1] = able
        starts = starts[able & (beside[:-2] | beside[2:])]
        for s, length, q in found:
            if 2 * q <= size and length >= 3 * size - 1:
                inside = (starts >= s) & (starts + 3 * size - 1 <= s + length)
                starts = starts[~inside]
        if len(starts):
            found += _runs_at(x, size, starts, found)
        size *= 2
    return sorted((s, length, q) for s, length, q in found)


def _runs_at(
    x: np.ndarray, size: int, starts: np.ndarray, known: list[tuple[int, int, int]]
) -> list[tuple[int, int, int]]:
    """The runs whose period is at least ``size`` and below twice that, from the blocks at ``starts``."""
    n = len(x)
    # What follows the text is a number that no word has.
    padded = np.concatenate([x, np.full(2 * size, n, np.int64)])
    rows = max(PIECE // (2 * size), 1)
    at, distance = [], []
    for i in range(0, len(starts), rows):
        here = starts[i : i + rows]
        blocks = padded[here[:, None] + np.arange(size)]
        windows = padded[here[:, None] + size + np.arange(2 * size - 1)]
        row, j = np.nonzero(_matches(blocks, windows))
        at.append(here[row])
        distance.append(j + size)
    at, distance = np.concatenate(at), np.concatenate(distance)
    for s, length, q in known:
        if length < 2 * size:
            continue
        lo, hi = np.searchsorted(at, [s, s + length])
        part = slice(lo, hi)
        explained = (distance[part] % q == 0) & (at[part] + distance[part] + size <= s + length)
        if explained.any():
            stays = np.ones(len(at), bool)
            stays[part] = ~explained
            at, distance = at[stays], distance[stays]
    order = np.lexsort((at, distance))
    at, distance = at[order], distance[order]
    out = []
    i = 0
    while i < len(at):
        b, d = int(at[i]), int(distance[i])
        if not np.array_equal(x[b : b + size], x[b + d : b + d + size]):
            i += 1
            continue
        lo = b - _grown(x, b - 1, d, -1)
        hi = b + size + _grown(x, b + size, d, 1)
        length = hi - lo + d
        if length >= max(MIN_WORDS, MIN_PERIODS * d):
            out.append((lo, length, d))
        # Later seeds of the same distance within this stretch would extend to it again.
        last = int(np.searchsorted(distance, d, "right"))
        i += int(np.searchsorted(at[i:last], hi - size, "right"))
    return out


def word_numbers(words: list[bytes]) -> np.ndarray:
    """The same number for equal words, below the number of words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stay when each run keeps its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        gone[s + q] += 1
        gone[s + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]


def periodic_runs(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the struct ``name``: ``n_words``, ``runs`` by start and period, ``best``, ``collapsed``.

    ``best`` is the run with the greatest length by period, NULL without runs. ``collapsed`` holds the words that stay, joined by a space: of every run the words after its first
    period go.
    """
    if fresh(docs, name) != name:
        raise ValueError(f"there is a column {name} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = []
            for value in batch.column(text).to_pylist():
                words = (value or "").encode().split()
                runs = runs_of(word_numbers(words))
                best = best_run(runs)
                made.append(
                    {
                        "n_words": len(words),
                        "runs": [dict(zip(NAMES, r, strict=True)) for r in runs],
                        "best": best and dict(zip(NAMES, best, strict=True)),
                        "collapsed": b" ".join(collapse(words, runs)).decode(),
                    }
                )
            made = pa.array(made, _FIELDS)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, FIELDS)]))
