"""Fill-in-middle, SimHash and periodic runs against plain Python on small frames."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from topicloom.llm import fim, periodic, simhash
from topicloom.llm.queries import QUERIES
from topicloom.runtime import cut

DOCS = "doc_id long, text string, `n` int, `_f` int, `_h` int"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return cut(spark.createDataFrame([(i, t, 7, 7, 7) for i, t in zip(ids, texts, strict=True)], DOCS))


def folder(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


# Fill-in-middle


def letters(rng, n):
    return "".join(rng.choice(["a", "é", "語", "\U0001f600", " ", "\n", "<", "P", ">", "S"]) for _ in range(n))


@pytest.mark.parametrize("bound", [0, 3, 96])
def test_rank_index_is_exact(bound):
    rng = random.Random(bound)
    texts = ["", "a" * 5000, letters(rng, 4000), "é" * 300 + "a" * 300, "", "語", letters(rng, 1)]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    index = fim.RankIndex(np.frombuffer(data, np.uint8), offsets, bound)
    whole = "".join(texts)
    want = np.cumsum([0, *[len(c.encode()) for c in whole]])
    assert index.offset(np.arange(len(whole) + 1)).tolist() == want.tolist()
    assert np.abs(index.residual).max() <= bound
    if bound == 96:
        assert len(index.starts) < len(whole) / 50


def plain_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    if h[3] % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(fim, "PIECE_BYTES", 2000)
    rng = random.Random(5)
    texts = [letters(rng, rng.randrange(0, 60)) for _ in range(300)] + [None, "", "<S>", "x<M>y", letters(rng, 90_000)]
    ids = [*range(len(texts) - 2), 3, None]
    docs = frame(spark, texts, ids)
    made = fim.fill_in_middle(docs, "doc_id", "text", "fim")
    back = made.withColumn("back", fim.restore(F.col("fim.output"), F.col("fim.form"))).collect()
    assert made.columns == [*docs.columns, "fim"]
    assert sorted([(r.doc_id is None, r.doc_id or 0, r.text or "", tuple(r.fim)) for r in back]) == sorted(
        [(i is None, i or 0, t or "", plain_fim(i, t)) for i, t in zip(ids, texts, strict=True)], key=lambda x: x[:3]
    )
    assert all(r.back == (r.text or "") for r in back)
    assert {r.fim.form for r in back} == {"plain", "psm", "spm"}


def test_fill_in_middle_edges(spark):
    assert fim.fill_in_middle(frame(spark, []), "doc_id", "text", "fim").count() == 0
    with pytest.raises(ValueError, match="already"):
        fim.fill_in_middle(frame(spark, ["a"]), "doc_id", "text", "N")


# SimHash


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_every_pair_within_the_radius_is_equal_under_a_mask():
    made = simhash.masks()
    assert len(made) == 7 and {m.bit_count() for m in made} <= {36, 37}
    for i in range(64):
        for j in range(i + 1):
            off = 1 << i | 1 << j
            assert any(not m & off for m in made)


@pytest.mark.parametrize("limit", [32, 2, 1])
def test_links_join_all_that_is_near(spark, limit):
    rng = random.Random(limit)
    prints = {rng.getrandbits(64) for _ in range(30)} | {0, 1, 3, 7, (1 << 64) - 1, 1 << 63}
    for p in list(prints)[:10]:
        for _ in range(40):
            p ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    rows = cut(spark.createDataFrame([(simhash._signed(p),) for p in prints], "f long"))
    found = [(r.x % (1 << 64), r.y % (1 << 64)) for r in simhash.links(rows, pair_limit=limit).collect()]
    assert all(0 < (x ^ y).bit_count() <= 2 for x, y in found)
    place = {p: i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in found:
        a, b = find(place[x]), find(place[y])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(prints))] == plain_components(prints)


def test_near_groups_equal_plain(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_PIECE_WORDS", 300)
    rng = random.Random(2)
    vocab = [f"w{i}É" for i in range(300)]
    texts = []
    for _ in range(8):
        base = rng.choices(vocab, k=400)
        for _ in range(6):
            texts.append(" ".join(base))
            base[rng.randrange(400)] = rng.choice(vocab)
    texts += [None, "", " \n\t", "One", "one", "one two", "A  b\nC", "a b c", " ".join(rng.choices(vocab, k=3000))]
    texts += ["x y z " * 400, texts[0]]
    docs = frame(spark, texts)
    got = sorted(simhash.near_groups(docs, "doc_id", "text").collect(), key=lambda r: r.doc_id)
    prints = [plain_print(t) for t in texts]
    assert [int(r.fingerprint, 16) for r in got] == prints
    assert [r.component_id for r in got] == plain_components(prints)
    assert got[0].asDict().keys() == {"doc_id", "n", "_f", "_h", "fingerprint", "component_id"}


def test_near_groups_edges(spark):
    assert simhash.near_groups(frame(spark, []), "doc_id", "text").count() == 0
    rows = frame(spark, ["a b", None, "a b", "a b", "c", None], [None, 4, 9, 9, None, 2])
    got = simhash.near_groups(rows, "doc_id", "text").collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [
        ("2", "2"), ("4", "2"), ("9", "9"), ("9", "9"), ("None", "9"), ("None", "None")
    ]
    with pytest.raises(ValueError, match="already"):
        simhash.near_groups(frame(spark, ["a"]), "doc_id", "text", "n")


# Periodic runs


def plain_runs(x):
    out = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            smaller = any(
                q % p == 0 and all(x[k] == x[k + p] for k in range(i, i + length - p)) for p in range(1, q)
            )
            if j > i and length >= max(6, 4 * q) and not smaller:
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


def sequences(rng, count):
    for _ in range(count):
        n, k = rng.randrange(0, 300), rng.choice([1, 2, 3, 5, 60])
        words = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(0, 4) if n else 0):
            a = rng.randrange(n)
            p, end = rng.randint(1, max(1, (n - a) // 3)), rng.randint(a, n)
            for i in range(a, end):
                words[i] = words[a + (i - a) % p]
        yield words


@pytest.mark.parametrize("schoolbook", [1, 16])
def test_runs_equal_brute_force(monkeypatch, schoolbook):
    monkeypatch.setattr(periodic, "SCHOOLBOOK", schoolbook)
    for words in sequences(random.Random(schoolbook), 400):
        assert periodic.runs_of(periodic.word_numbers(words)) == plain_runs(words)


def test_runs_of_long_sequences():
    assert periodic.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    assert periodic.runs_of(np.arange(40_000) % 9_000) == [(0, 40_000, 9_000)]
    assert periodic.runs_of(np.arange(30_000)) == []


def test_transform_round_trip_and_product():
    rng = np.random.default_rng(1)
    x = rng.integers(0, periodic.PRIME, (3, 32), dtype=np.uint64)
    assert (periodic.inverse(periodic.transform(x)) == x).all()


def plain_row(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_op13_equals_plain(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(f"é{w}" for w in words) for words in sequences(rng, 150)]
    texts += [None, "", "  ", "a\ta\na a a\x0ba", "b " * 400, "a b a b a b a", "a a " * 6]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "c c c c c c"), (3, texts[3])]
    got = QUERIES["op13_periodic_runs"](spark, folder(spark, tmp_path, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain_row(*r)) for r in rows)


def test_periodic_edges(spark):
    assert periodic.periodic_runs(frame(spark, []), "text", "found").count() == 0
    with pytest.raises(ValueError, match="already"):
        periodic.periodic_runs(frame(spark, ["a"]), "text", "_F")
    got = periodic.periodic_runs(frame(spark, ["x a a a a a a y"]), "text", "found").first()
    assert (got.n, got.found.collapsed, got.found.n_words) == (7, "x a y", 8)


def test_queries_of_an_empty_table(spark, tmp_path):
    where = folder(spark, tmp_path, [])
    for name in ("op11_fill_in_middle", "op12_simhash_near_dedup", "op13_periodic_runs"):
        assert QUERIES[name](spark, where).count() == 0


def test_words_of_bytes_are_those_of_the_contract():
    every = "".join(map(chr, [*range(1, 0x3000), 0x1F600]))
    assert every.encode().split() == [
        w.encode() for w in every.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w
    ]
