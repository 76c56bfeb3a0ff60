import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Plain

from topicloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Plain.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def ids(packed):
    return bpe.np.frombuffer(packed, "<u4").tolist()


def test_every_character_is_cut_as_the_library_cuts_it(plain, vocabulary):
    encoder = bpe.Encoder(vocabulary, None)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)}\n" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    bad = []
    for text, want in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        if ids(encoder.encode(text)) != want.ids:
            bad += [hex(ord(c)) for c in dict.fromkeys(text) if ids(encoder.encode(f"a{c}b {c}1{c}{c}\n")) != plain.encode(f"a{c}b {c}1{c}{c}\n", add_special_tokens=False).ids]
    assert bad == []


def test_long_words_special_tokens_and_spaces(plain, vocabulary):
    encoder = bpe.Encoder(vocabulary, None)
    rng = random.Random(1)
    texts = ["", " ", "\n\n  x", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "x" * 5000, "it's we'll I'D 'S",
             "   tab\t\t end  ", "\x1c\x1d a\x85b᠎​"]
    texts += ["".join(rng.choice("ab \n'éß漢1.<|>") for _ in range(400)) for _ in range(200)]
    for text in texts:
        got = encoder.encode(text)
        want = plain.encode(text, add_special_tokens=False).ids
        assert ids(got) == want, text
        assert encoder.decode(got) == plain.decode(want, skip_special_tokens=False) == text


def test_lexicon_holds_exactly_its_words(tmp_path):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))).encode() for _ in range(800)})
    path = str(tmp_path / "lexicon")
    bpe.build_lexicon(((w, list(w) * 2) for w in words), path)
    lexicon = bpe.Lexicon(path)
    assert all(ids(lexicon.get(w)) == list(w) * 2 for w in words)
    for _ in range(2000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))).encode()
        assert (lexicon.get(w) is not None) == (w in set(words))
    assert lexicon.get(b"") is None


def test_tables(spark, plain):
    rows = [(1, "some words, some more"), (2, None), (3, ""), (3, ""), (4, "word " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, t string").withColumn("word", bpe.F.lit(1))
    tok = bpe.Tokenizer.fit(docs, "t", PATH, 3)
    got = tok.decode(tok.encode(docs, "t", "ids"), "ids", "back").collect()
    assert [(r.doc_id, r.back) for r in got] == [(i, t or "") for i, t in rows]
    for r in got:
        assert ids(r.ids) == plain.encode(r.t or "", add_special_tokens=False).ids
    none = docs.where("doc_id < 0")
    assert bpe.Tokenizer.fit(none, "t", PATH).encode(none, "t", "ids").count() == 0
    for r in tok.encode_lists(docs, "t", "ids").collect():
        assert r.ids == plain.encode(r.t or "", add_special_tokens=False).ids
