"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus is counted once; its most frequent words are merged on the driver and
compiled into an automaton that shares prefixes and suffixes: a word's path adds
up to its number, and the number leads to its ids. The automaton is one file
that Spark sends to every executor, where the tasks map it into memory. A word
that it does not hold is merged exactly, so the lexicon changes only the speed.

Text is cut into words as the byte-level pre-tokenizer does; special tokens in a
text are taken as such. Which words the lexicon holds is a bounded choice
(``lexicon_words``); every text is read whole.

Defined results: a NULL or empty text has no ids and decodes to the empty text;
repeated rows are encoded each; an empty table gives an empty table; other
columns are untouched.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import shutil
import sys
import tempfile
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import fresh, ref
from topicloom.llm.words import sliced

LEXICON_WORDS = 1 << 16
#: Different words a task counts before it forgets the rarer half.
COUNTED = 1 << 18
#: Words a worker remembers.
REMEMBERED = 1 << 17
#: Bytes of a word that is merged with plain lists instead of a queue.
SHORT = 64
#: First bytes of a word whose state in the lexicon is remembered, and how many of them.
HEAD, HEADS = 4, 1 << 16
_NONE = 1 << 62
_BYTES = [bytes([b]) for b in range(256)]

# Fixed value: how the pre-tokenizer cuts a text into words.
_SPACE = r"\p{White_Space}"
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?!\P{{White_Space}})|{_SPACE}+"
)

# The same for texts of ASCII and the letters of Latin-1 alone, which is most.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = re.compile(f"[^\x00-\x7f{_LATIN}]")
_PLAIN_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+"
    rf"| ?[^ \t-\r{_LATIN}0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
)


def words_of(text: str) -> list[str]:
    """The words of a text, which together are the text."""
    return (_PLAIN_WORDS if text.isascii() or not _OTHER.search(text) else WORDS).findall(text)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """A byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = _byte_letters()
        vocab = data["model"]["vocab"]
        size = max([*vocab.values(), *[t["id"] for t in data["added_tokens"]]]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self._byte_id = [0] * 256
        for letter, b in letters.items():
            self._byte_id[b] = vocab[letter]
        self._merge = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._merge[vocab[left] << 24 | vocab[right]] = rank << 24 | vocab[left + right]
        found = sorted(self.special, key=len, reverse=True)
        self._special = regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None

    def split(self, text: str) -> list[str]:
        """The text at odd places, special tokens at even ones (from 1)."""
        if self._special is None or not any(s in text for s in self.special):
            return [text]
        return self._special.split(text)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: of all neighbours the best ranked pair merges first, the leftmost of equals."""
        ids = [self._byte_id[b] for b in word]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        find = self._merge.get
        ranks = [find(a << 24 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            made = best & 0xFFFFFF
            ids[i] = made
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = find(ids[i - 1] << 24 | made, _NONE)
            if i < len(ranks):
                ranks[i] = find(made << 24 | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a queue, for words of any length."""
        find, n = self._merge.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(i: int, j: int) -> None:
            found = find(ids[i] << 24 | ids[j])
            if found is not None:
                heapq.heappush(queue, (found >> 24, i, found & 0xFFFFFF, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, made, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [i for i in ids if i >= 0]


def build_lexicon(entries: Iterable[tuple[bytes, list[int]]], path: str) -> None:
    """Write the minimal acyclic automaton of the words, given in order, and their ids.

    Words are added in byte order. What a new word no longer shares with the one
    before is finished: each of its states is replaced by an equal one, if there
    is one, so equal suffixes are stored once.
    """
    states: list[tuple[bool, list[list[int]]]] = [(False, [])]
    known: dict = {}
    path_ = [0]
    previous = b""
    outputs: list[int] = []
    starts = [0]

    def finish(down_to: int) -> None:
        while len(path_) > down_to + 1:
            state = path_.pop()
            final, edges = states[state]
            same = known.setdefault((final, tuple(map(tuple, edges))), state)
            states[path_[-1]][1][-1][1] = same

    for word, ids in entries:
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        finish(shared)
        for b in word[shared:]:
            states.append((False, []))
            states[path_[-1]][1].append([b, len(states) - 1])
            path_.append(len(states) - 1)
        states[path_[-1]] = (True, states[path_[-1]][1])
        previous = word
        outputs += ids
        starts.append(len(outputs))
    finish(0)

    # States that are still reached, and how many words each leads to.
    number, order, below = {}, [], {}
    stack = [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            below[state] = states[state][0] + sum(below[t] for _, t in states[state][1])
        elif state not in number:
            number[state] = len(order)
            order.append(state)
            stack.append((state, True))
            stack += [(t, False) for _, t in states[state][1] if t not in number]
    first, label, target, skip, final = [0], bytearray(), [], [], bytearray()
    for state in order:
        is_final, edges = states[state]
        passed = int(is_final)
        for b, t in edges:
            label.append(b)
            target.append(number[t])
            skip.append(passed)
            passed += below[t]
        first.append(len(label))
        final.append(is_final)
    parts = [np.array(a, "<u4").tobytes() for a in (first, target, skip, starts, outputs)]
    parts += [bytes(label), bytes(final)]
    with open(path, "wb") as f:
        f.write(np.array([len(p) for p in parts], "<u8").tobytes())
        for p in parts:
            f.write(p)


class Lexicon:
    """The automaton of a file, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self._map[:56], "<u8").tolist()
        at, view, parts = 56, memoryview(self._map), []
        for size in sizes:
            parts.append(view[at : at + size])
            at += size
        self._first, self._target, self._skip, self._starts, _ = (p.cast("I") for p in parts[:5])
        self._outputs, self._label, self._final = parts[4:7]
        self._labels = 56 + sum(sizes[:5])
        self._heads: dict[bytes, tuple[int, int]] = {}

    def _walk(self, state: int, n: int, letters: bytes) -> tuple[int, int]:
        """The state that ``letters`` lead to (-1: none), and the number they add up to."""
        first, target, skip, label = self._first, self._target, self._skip, self._label
        for b in letters:
            at, end = first[state], first[state + 1]
            if at == end:
                return -1, 0
            if label[at] != b:
                at = self._map.find(_BYTES[b], self._labels + at + 1, self._labels + end) - self._labels
                if at < 0:
                    return -1, 0
            n += skip[at]
            state = target[at]
        return state, n

    def get(self, word: bytes) -> bytes | None:
        """The packed ids of a word; where its first letters lead to is remembered."""
        head = word[:HEAD]
        place = self._heads.get(head)
        if place is None:
            place = self._walk(0, 0, head)
            if len(self._heads) < HEADS:
                self._heads[head] = place
        state, n = place
        if state >= 0:
            state, n = self._walk(state, n, word[HEAD:])
        if state < 0 or not self._final[state]:
            return None
        return bytes(self._outputs[4 * self._starts[n] : 4 * self._starts[n + 1]])


def _pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Encoder(dict):
    """Packed ids by word: remembered, from the lexicon, or merged.

    The lexicon's words stay remembered, so the many rare words push none of them out.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        super().__init__()
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self._frequent: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = self.lexicon.get(raw) if self.lexicon else None
        if ids is None:
            ids = _pack(self.vocabulary.merge(raw))
        elif len(self._frequent) < LEXICON_WORDS:
            self._frequent[word] = ids
        if len(self) >= REMEMBERED:
            self.clear()
            self.update(self._frequent)
        if len(word) <= 256:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        out = []
        for i, part in enumerate(self.vocabulary.split(text)):
            if i % 2:
                out.append(_pack([self.vocabulary.special[part]]))
            else:
                out += [self[w] for w in words_of(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        known = self.vocabulary.bytes_of
        return b"".join([known[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _lists(packed: list[bytes]) -> pa.Array:
    """Packed ids as an array of lists."""
    ends = np.cumsum([0, *[len(p) // 4 for p in packed]])
    return pa.ListArray.from_arrays(ends.astype(np.int32), np.frombuffer(b"".join(packed), "<u4").astype(np.int32))


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(vocabulary: str, lexicon: str) -> Encoder:
    """The worker's encoder for two files that Spark has sent."""
    key = (vocabulary, lexicon)
    if key not in _encoders:
        _encoders.clear()
        words = Lexicon(SparkFiles.get(lexicon)) if lexicon else None
        _encoders[key] = Encoder(Vocabulary(SparkFiles.get(vocabulary)), words)
    return _encoders[key]


def word_counts(docs: DataFrame, text: str, keep: int) -> DataFrame:
    """``word, n`` over the whole corpus; each task reports its ``keep`` most frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in sliced(batches):
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(words_of(t))
                if len(counts) > COUNTED:
                    counts = Counter(dict(counts.most_common(COUNTED // 2)))
        top = counts.most_common(keep)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
            names=["word", "n"],
        )

    found = docs.select(ref(text).alias("t")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class Tokenizer:
    """A vocabulary and a lexicon, sent to all executors."""

    def __init__(self, spark, vocabulary_path: str, words: Iterable[str] = ()):
        vocabulary = Vocabulary(vocabulary_path)
        raw = sorted({w.encode() for w in words} - {b""})
        self.lexicon = ""
        folder = tempfile.mkdtemp(prefix="lexicon-")  # the driver's, Spark copies the files from it
        if raw:
            self.lexicon = f"lexicon-{uuid.uuid4().hex}"
            build_lexicon(((w, vocabulary.merge(w)) for w in raw), os.path.join(folder, self.lexicon))
            spark.sparkContext.addFile(os.path.join(folder, self.lexicon))
        self.vocabulary = f"vocabulary-{uuid.uuid4().hex}.json"
        shutil.copyfile(vocabulary_path, os.path.join(folder, self.vocabulary))
        spark.sparkContext.addFile(os.path.join(folder, self.vocabulary))

    @classmethod
    def fit(cls, docs: DataFrame, text: str, vocabulary_path: str, lexicon_words: int = LEXICON_WORDS):
        """With the corpus's most frequent words as lexicon."""
        counts = word_counts(docs, text, lexicon_words)
        top = counts.orderBy(F.desc("n"), "word").limit(lexicon_words).collect()
        return cls(docs.sparkSession, vocabulary_path, (r["word"] for r in top))

    def _map(self, df: DataFrame, column: str, name: str, kind: str, make) -> DataFrame:
        if fresh(df, name) != name:
            raise ValueError(f"there is a column {name} already")
        vocabulary, lexicon = self.vocabulary, self.lexicon

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = _encoder(vocabulary, lexicon)
            for batch in sliced(batches):
                made = make(encoder, batch.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

        schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
        return df.mapInArrow(run, schema)

    def encode(self, docs: DataFrame, text: str, ids: str) -> DataFrame:
        """``docs`` with ``ids``, packed as little-endian unsigned 32-bit numbers."""
        return self._map(docs, text, ids, "binary", lambda e, texts: pa.array([e.encode(t or "") for t in texts], pa.binary()))

    def encode_lists(self, docs: DataFrame, text: str, ids: str) -> DataFrame:
        """``docs`` with ``ids`` as arrays of numbers, made by the worker that encodes."""
        return self._map(docs, text, ids, "array<int>", lambda e, texts: _lists([e.encode(t or "") for t in texts]))

    def decode(self, coded: DataFrame, ids: str, text: str) -> DataFrame:
        """``coded`` with the ``text`` of its packed ids."""
        return self._map(coded, ids, text, "string", lambda e, packed: pa.array([e.decode(b or b"") for b in packed], pa.string()))
