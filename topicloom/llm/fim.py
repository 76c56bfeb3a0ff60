"""Fill-in-middle texts: two cuts a text, found through a learned rank index, and the way back.

A cut is given as a number of code points, a text lies in memory as UTF-8 bytes.
The rank index of a text answers "at which byte does code point ``r`` begin?".
Its boundary offsets are fitted by line segments: a segment runs from its first
to its last boundary and is halved until no boundary lies further than ``BOUND``
bytes from its line. What remains, at most ``BOUND``, is stored in one byte a
boundary, so segment, prediction and residual give every offset exactly. All
texts of a piece of a batch are fitted at once; a text's first segment starts at
its first boundary.

A transformed text holds three sentinels before its parts. Texts that contain
one, and a stated share of all texts, are left plain, so that the first sentinel
of each kind found from the left always is the one that was put in (no sentinel
can overlap another or a text's end).

Defined results: a NULL or empty text is plain and empty; a NULL id hashes as
the empty string, so rows that repeat an id are cut by the same numbers; an
empty table gives an empty table; other columns stay as they are, and a column
with the name of the result is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import fresh, ref
from topicloom.llm.words import text_buffer

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, so many stay plain; of 100 others, so many put the suffix first.
PLAIN_SHARE, SPM_SHARE = 10, 20
#: Bytes that a boundary may lie from its segment's line; has to fit a signed byte.
BOUND = 96
#: Bytes of text that are indexed together, or one text if that is longer.
PIECE_BYTES = 1 << 22

FIELDS = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


class RankIndex:
    """The byte offset of every code point of some texts that lie one after the other.

    ``data`` holds UTF-8, ``offsets`` the first byte of each text and the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, bound: int = BOUND):
        if not 0 <= bound <= 127:
            raise ValueError("bound has to fit a signed byte")
        at = np.flatnonzero((data & 0xC0) != 0x80)
        #: Rank of the first code point of every text, and the number of code points.
        self.ranks = np.searchsorted(at, offsets)
        self._end = int(offsets[-1])
        self._fit(at, bound)

    def _fit(self, at: np.ndarray, bound: int) -> None:
        starts = np.unique(self.ranks[self.ranks < len(at)])
        ends = np.append(starts[1:], len(at))
        residual = np.zeros(len(at), np.int8)
        done = []
        while len(starts):
            steps = np.maximum(ends - starts - 1, 1)
            slope = (at[ends - 1] - at[starts]) / steps
            size = ends - starts
            segment = np.repeat(np.arange(len(starts)), size)
            first = np.cumsum(size) - size
            rank = np.arange(int(size.sum())) - first[segment] + starts[segment]
            off = at[rank] - _line(at[starts], slope, starts, segment, rank)
            good = np.maximum.reduceat(np.abs(off), first) <= bound
            fine = good[segment]
            residual[rank[fine]] = off[fine]
            done.append((starts[good], at[starts[good]], slope[good]))
            middle = (starts[~good] + ends[~good]) // 2
            starts, ends = (
                np.column_stack([starts[~good], middle]).ravel(),
                np.column_stack([middle, ends[~good]]).ravel(),
            )
        self.residual = residual
        self.starts, self.base, self.slope = (
            np.concatenate(p) if done else np.zeros(0) for p in (zip(*done, strict=True) if done else ((), (), ()))
        )
        order = np.argsort(self.starts)
        self.starts, self.base, self.slope = self.starts[order], self.base[order], self.slope[order]

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """The first byte of each code point of the given ranks; of the one after the last, the end."""
        out = np.full(len(rank), self._end, np.int64)
        here = rank < len(self.residual)
        r = rank[here]
        segment = np.searchsorted(self.starts, r, "right") - 1
        out[here] = _line(self.base, self.slope, self.starts, segment, r) + self.residual[r]
        return out


def _line(base: np.ndarray, slope: np.ndarray, start: np.ndarray, segment: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return base[segment] + np.rint(slope[segment] * (rank - start[segment])).astype(np.int64)


def cut_numbers(doc_id: Column, seed: str = "1") -> list[Column]:
    """Four numbers below 2**32 that only depend on the seed and the id."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _pieces(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[slice]:
    """Row ranges whose texts are ``PIECE_BYTES`` together at most, or one row."""
    ends = np.diff(text_buffer(texts)[1]).cumsum()
    row = 0
    while row < batch.num_rows:
        before = int(ends[row - 1]) if row else 0
        stop = max(int(np.searchsorted(ends, before + PIECE_BYTES, "right")), row + 1)
        yield slice(row, stop)
        row = stop


def _transformed(texts: pa.Array, numbers: list[np.ndarray]) -> pa.Array:
    data, offsets = text_buffer(texts)
    index = RankIndex(data, offsets)
    first, n = index.ranks[:-1], np.diff(index.ranks)
    h1, h2, h3, h4 = numbers
    low = np.minimum(h1 % (n + 1), h2 % (n + 1))
    high = np.maximum(h1 % (n + 1), h2 % (n + 1))
    cuts = index.offset(np.concatenate([first + low, first + high]))
    one, two = cuts[: len(n)].tolist(), cuts[len(n) :].tolist()
    whole, ends = data.tobytes(), offsets.tolist()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out, forms = [], []
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        text = whole[a:b]
        if not text or h3[i] % 100 >= 100 - PLAIN_SHARE or p in text or s in text or m in text:
            out.append(text)
            forms.append("plain")
            continue
        head, body, tail = whole[a : one[i]], whole[one[i] : two[i]], whole[two[i] : b]
        if h4[i] % 100 < SPM_SHARE:
            out.append(b"".join((s, tail, p, head, m, body)))
            forms.append("spm")
        else:
            out.append(b"".join((p, head, s, tail, m, body)))
            forms.append("psm")
    plain = np.array([f == "plain" for f in forms], bool)
    return pa.StructArray.from_arrays(
        [
            pa.array(n, pa.int64()),
            pa.array(forms, pa.string()),
            pa.array(low, pa.int64(), mask=plain),
            pa.array(high - low, pa.int64(), mask=plain),
            pa.array(out, pa.binary()).cast(pa.string()),
        ],
        names=FIELDS.names,
    )


def fill_in_middle(docs: DataFrame, doc_id: str, text: str, name: str, seed: str = "1") -> DataFrame:
    """``docs`` with the struct ``name``: ``n, form, prefix_chars, middle_chars, output`` of every whole text."""
    if fresh(docs, name) != name:
        raise ValueError(f"there is a column {name} already")
    helpers: list[str] = []
    rows = docs
    for number in cut_numbers(ref(doc_id), seed):
        helpers.append(fresh(rows, "_h"))
        rows = rows.withColumn(helpers[-1], number)

    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, batch.column(text)):
                part = batch.slice(piece.start, piece.stop - piece.start)
                numbers = [part.column(h).to_numpy() for h in helpers]
                made = _transformed(part.column(text), numbers)
                others = [part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*others, made], names=[*columns, name])

    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, FIELDS)]))


def restore(output: Column, form: Column) -> Column:
    """The text that a transformed one was made of."""

    def after(c: Column, sentinel: str) -> Column:
        return F.substring(c, F.locate(sentinel, c) + len(sentinel), F.char_length(c))

    def before(c: Column, sentinel: str) -> Column:
        return F.substring(c, F.lit(1), F.locate(sentinel, c) - 1)

    # What follows the opening sentinel, then what follows the next one.
    psm = after(output, PREFIX)
    psm_rest = after(psm, SUFFIX)
    spm = after(output, SUFFIX)
    spm_rest = after(spm, PREFIX)
    return (
        F.when(form == "psm", F.concat(before(psm, SUFFIX), after(psm_rest, MIDDLE), before(psm_rest, MIDDLE)))
        .when(form == "spm", F.concat(before(spm_rest, MIDDLE), after(spm_rest, MIDDLE), before(spm, PREFIX)))
        .otherwise(output)
    )
