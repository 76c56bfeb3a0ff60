"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

Two words are compared by the three-letter subsequences they share, each weighed
by how far its letters lie apart (at most ``SPAN`` letters), so an insult with
letters put in or left out still resembles itself. The kernel has an explicit
map: a subsequence is a coordinate. Words are taken in lower case, from their
letters alone, with a mark before the first; letters that stand alone, three or
more in a row, are read as one word.

Landmarks are words of the training texts: those that toxic texts have and clean
ones have not, and the clean words most like them. A text is as near to a
landmark as its nearest word; resemblance below ``LEAST`` counts as none, which
spares nearly every word of a corpus the whole comparison. The landmarks' own
kernel matrix, inverted to the half, turns these into coordinates, on which a
linear SVM with squared hinge loss is fitted and its margins are calibrated.

Training reads at most ``TRAIN_TEXTS`` labelled texts, chosen by the hash of the
text, half of them toxic as far as there are; every text is scored whole.

Defined results: a NULL or empty text has no words and the score of a text
unlike all landmarks; labels other than 0 and 1 are not used; repeated rows are
scored alike; without texts of both labels every score is 0; an empty table
gives an empty table; other columns are untouched.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import fresh, ref
from topicloom.llm.words import mix, sliced
from topicloom.runtime import cut

TRAIN_TEXTS = 4000
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 128, 32
#: A landmark is in this share of the toxic training texts at least (and in three).
LANDMARK_SHARE = 0.004
SPAN = 5
DECAY = 0.75
LEAST = 0.5
#: The kernel is taken to this power, which sets a word's likes apart from what only resembles it.
POWER = 2
#: Different words a worker remembers.
REMEMBERED = 1 << 18
_LETTERS = re.compile(r"[\W\d_]+")
_ALONE = re.compile(r"(?<!\S)[^\W\d_](?:[\s.\-_*]+[^\W\d_](?!\S)){2,}")
_MARK = "^"
_PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def units(text: str | None) -> set[str]:
    """The different words of a text as written, in lower case, and its runs of lone letters."""
    if not text:
        return set()
    low = text.lower()
    found = set(low.split())
    found.update(_ALONE.findall(low))
    return found


def letters(unit: str) -> str:
    return _LETTERS.sub("", unit)


def _norm(n: np.ndarray) -> np.ndarray:
    """Root of the summed squared weights of all subsequences of a word of ``n`` letters, mark included."""
    total = np.zeros(len(n))
    for _, b in _PAIRS:
        total += np.maximum(n - b, 0) * DECAY ** (2 * (b + 1))
    return np.sqrt(total)


def _subsequences(words: list[str], letter: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Word number and code of every subsequence of known letters, with its weight, by distance."""
    n = np.array([len(w) + 1 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), n)
    codes = np.array([letter.get(c, -1) for w in words for c in _MARK + w], np.int64)
    for a, b in _PAIRS:
        if len(codes) <= b:
            continue
        x, y, z = codes[:-b], codes[a : len(codes) - b + a], codes[b:]
        ok = (x >= 0) & (y >= 0) & (z >= 0) & (owner[:-b] == owner[b:])
        yield owner[:-b][ok], (x[ok] * len(letter) + y[ok]) * len(letter) + z[ok], DECAY ** (b + 1)


class Landmarks:
    """Words that others are compared with."""

    def __init__(self, words: list[str]):
        self.words = words
        self.letter = {c: i for i, c in enumerate(sorted({_MARK, *"".join(words)}))}
        rows, codes, weights = [], [], []
        for owner, code, weight in _subsequences(words, self.letter):
            rows.append(owner)
            codes.append(code)
            weights.append(np.full(len(code), weight))
        codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        self.codes, at = np.unique(codes, return_inverse=True)
        self.table = np.zeros((len(self.codes) + 1, len(words)), np.float32)
        if len(codes):
            np.add.at(self.table, (at, np.concatenate(rows)), np.concatenate(weights))
        self.table /= np.maximum(_norm(np.array([len(w) + 1 for w in words], np.int64)), 1e-12)
        self.most = self.table.max(axis=1, initial=0)

    def compare(self, words: list[str]) -> np.ndarray:
        """Resemblance of each word to each landmark, 0 below ``LEAST``."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        if not words or not len(self.codes):
            return out
        norm = np.maximum(_norm(np.array([len(w) + 1 for w in words], np.int64)), 1e-12)
        parts = []
        bound = np.zeros(len(words))
        for owner, code, weight in _subsequences(words, self.letter):
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[at] == code
            owner, at = owner[hit], at[hit]
            bound += np.bincount(owner, weight * self.most[at], len(words))
            parts.append((owner, at, weight))
        near = np.flatnonzero(bound / norm >= LEAST)
        row = np.full(len(words), -1)
        row[near] = np.arange(len(near))
        owner = np.concatenate([row[o] for o, _, _ in parts])
        at = np.concatenate([a for _, a, _ in parts])
        weight = np.concatenate([np.full(len(o), w, np.float32) for o, _, w in parts])
        some = np.zeros((len(near), len(self.words)), np.float32)
        order = np.argsort(owner, kind="stable")[np.count_nonzero(owner < 0) :]
        owner, at, weight = owner[order], at[order], weight[order]
        # Some words at a time as rows of subsequence weights: their products with the landmarks are one matrix.
        width = len(self.codes)
        rows = max((1 << 21) // width, 1)
        for first in range(0, len(near), rows):
            last = min(first + rows, len(near))
            lo, hi = np.searchsorted(owner, [first, last])
            cells = (owner[lo:hi] - first) * width + at[lo:hi]
            held = np.bincount(cells, weight[lo:hi], (last - first) * width).astype(np.float32)
            some[first:last] = held.reshape(-1, width) @ self.table[:width]
        some /= norm[near][:, None]
        some[some < LEAST] = 0
        out[near] = np.minimum(some, 1) ** POWER
        return out


class Nearness:
    """Resemblance of whole texts to the landmarks; words are compared once per worker."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self._known: dict[str, int] = {}
        self._rows: list[np.ndarray] = []

    def of(self, texts: list[set[str]]) -> np.ndarray:
        if len(self._known) > REMEMBERED:
            self._known.clear()
            self._rows.clear()
        fresh = list(set().union(*texts).difference(self._known)) if texts else []
        for first in range(0, len(fresh), 1 << 15):
            part = fresh[first : first + (1 << 15)]
            found = self.landmarks.compare([letters(u) for u in part])
            some = found.any(axis=1)
            for unit, hit, row in zip(part, some.tolist(), found, strict=True):
                if hit:
                    self._known[unit] = len(self._rows)
                    self._rows.append(row.copy())
                else:
                    self._known[unit] = -1
        out = np.zeros((len(texts), len(self.landmarks.words)), np.float32)
        known = self._known
        for i, text in enumerate(texts):
            at = [n for n in map(known.__getitem__, text) if n >= 0]
            if at:
                out[i] = np.max([self._rows[n] for n in at], axis=0)
        return out


@dataclass(frozen=True)
class Model:
    """Landmark words, the weight of each one's nearness, and the intercept; both calibrated."""

    words: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def scores(self, near: np.ndarray) -> np.ndarray:
        margin = near @ np.array(self.weights) + self.intercept
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def choose_landmarks(texts: list[set[str]], labels: np.ndarray) -> list[str]:
    counts = {0: Counter(), 1: Counter()}
    for text, label in zip(texts, labels.tolist(), strict=True):
        counts[label].update({w for w in map(letters, text) if len(w) > 1})
    n = [int((labels == label).sum()) for label in (0, 1)]
    toxic, clean = counts[1], counts[0]

    def weight(w: str) -> float:
        """How much more often toxic texts have it, times how sure that is."""
        odds = np.log((toxic[w] + 0.5) / (n[1] + 1)) - np.log((clean[w] + 0.5) / (n[0] + 1))
        return toxic[w] * odds if toxic[w] >= max(3, LANDMARK_SHARE * n[1]) and odds > 2.5 else 0.0

    ranked = sorted(((weight(w), w) for w in toxic), key=lambda x: (-x[0], x[1]))
    chosen = [w for s, w in ranked[:TOXIC_LANDMARKS] if s > 0]
    if not chosen:
        return []
    common = [w for w, c in sorted(clean.items(), key=lambda x: (-x[1], x[0])) if c >= 2 and w not in set(chosen)]
    like = Landmarks(chosen).compare(common).max(axis=1)
    order = np.argsort(-like, kind="stable")[:CLEAN_LANDMARKS]
    return chosen + [common[i] for i in order if like[i] > 0]


def _fit_linear(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and intercept of a squared-hinge SVM, both labels weighing alike, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    c = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * cost
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        active = y * (x1 @ w) < 1
        xa, ya, ca = x1[active], y[active], c[active]
        new = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ ya)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of labels over margins, softened labels."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    c = np.where(y > 0, len(y) / (2 * pos), len(y) / (2 * neg))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (c * (p - target)) + 1e-3 * (w - [1.0, 0.0])
        hess = (x * (c * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _unlike(texts: list[set[str]]) -> list[int]:
    """Texts without near copies, whose words would all seem to go with one label.

    Of eight least hashes of their words, copies share three or more.
    """
    seen: set[tuple[int, ...]] = set()
    chosen = []
    for i, text in enumerate(texts):
        hashes = np.array([zlib.crc32(w.encode()) for w in text] or [0], np.uint64)
        least = [int(mix(hashes + np.uint64(k << 32)).min()) for k in range(8)]
        keys = [(a, least[a], least[b], b) for a in range(8) for b in range(a)]
        if sum(k in seen for k in keys) < 3:
            chosen.append(i)
            seen.update(keys)
    return chosen


def fit(texts: list[set[str]], labels: np.ndarray) -> Model:
    chosen = _unlike(texts)
    texts, labels = [texts[i] for i in chosen], labels[chosen]
    words = choose_landmarks(texts, labels) if len(set(labels.tolist())) == 2 else []
    if not words:
        return Model((), (), -500.0)
    landmarks = Landmarks(words)
    near = Nearness(landmarks).of(texts).astype(np.float64)
    gram = landmarks.compare(words).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    half = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ vector.T
    y = np.where(labels == 1, 1.0, -1.0)
    w = _fit_linear(near @ half, y)
    slope, offset = _calibrate(near @ half @ w[:-1] + w[-1], y)
    return Model(tuple(words), tuple((slope * (half @ w[:-1])).tolist()), float(slope * w[-1] + offset))


def train(labelled: DataFrame, text: str, label: str, train_texts: int = TRAIN_TEXTS) -> Model:
    """Fit on at most ``train_texts`` different texts, half of each label as far as there are."""
    rows = labelled.where(ref(label).isin(0, 1) & ref(text).isNotNull())
    rows = rows.select(ref(label).cast("int").alias("y"), F.xxhash64(ref(text)).alias("h"), ref(text).alias("t"))
    # Chosen by their hashes alone; only the chosen texts are read, and only their words leave a task.
    named = cut(rows.select("y", "h").distinct())
    texts, labels, words = [], [], {}
    for y in (1, 0):
        room = train_texts // 2 if y else train_texts - len(texts)
        chosen = F.broadcast(named.where(F.col("y") == y).orderBy("h").limit(room))  # rows bounded by room
        found = rows.join(chosen, ["y", "h"], "left_semi").select("h", "t").mapInArrow(_word_sets, _WORD_SETS)
        for r in found.dropDuplicates(["h"]).orderBy("h").collect():
            texts.append({words.setdefault(u, u) for u in r["units"]})
            labels.append(y)
    return fit(texts, np.array(labels, int))


_WORD_SETS = "h long, units array<string>"


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of every text, once for its copies in one task."""
    seen: set[int] = set()
    for batch in sliced(batches):
        hashes = batch.column("h").to_pylist()
        new = [i for i, h in enumerate(hashes) if h not in seen and not seen.add(h)]
        found = [sorted(units(batch.column("t")[i].as_py())) for i in new]
        yield pa.RecordBatch.from_arrays(
            [pa.array([hashes[i] for i in new], pa.int64()), pa.array(found, pa.list_(pa.string()))],
            names=["h", "units"],
        )


def score(docs: DataFrame, text: str, model: Model, name: str) -> DataFrame:
    """``docs`` with the toxicity ``name`` of every text, from 0 to 1."""

    if fresh(docs, name) != name:
        raise ValueError(f"there is a column {name} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearness = Nearness(Landmarks(list(model.words)))
        for batch in sliced(batches):
            made = model.scores(nearness.of([units(t) for t in batch.column(text).to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, name]
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Rows that training does not see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))
