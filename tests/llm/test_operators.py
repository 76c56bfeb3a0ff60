"""The operators on small frames: NULLs, empty and long texts, ties, repeats, no rows, clashing names."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import chat, jaccard, lines, mixing, pages, quality, substrings, topk, toxicity
from topicloom.llm.components import components
from topicloom.llm.words import count_words
from topicloom.runtime import cut

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, source string, n_words long, `_lines` int"


def frame(spark, rows):
    return cut(spark.createDataFrame([(*r, 7, 7) for r in rows], DOCS))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [" ".join(rng.choices(vocab, k=120)) for _ in range(6)]
    out = list(base)
    for b in base[:3]:
        for _ in range(12):
            words = b.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append(" ".join(words))
    passage = " ".join(rng.choices(vocab, k=60))
    out += [f"{' '.join(rng.choices(vocab, k=30))} {passage} {' '.join(rng.choices(vocab, k=30))}" for _ in range(5)]
    out += ["one two", "One  two", "", " \n", None, base[0], "A " * 200]
    return out


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1)))


def plain_groups(texts, n, num, den):
    sets = [shingles(t, n) for t in texts]
    group = list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and den * both >= num * (len(x) + len(sets[j]) - both):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("limit", [64, 2])
@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 8, 10)])
def test_similar_groups_equal_brute_force(spark, texts, monkeypatch, limit, n, num, den):
    monkeypatch.setattr(jaccard, "PAIR_LIMIT", limit)
    monkeypatch.setattr(jaccard, "BLOCK_WEIGHT", 900)
    docs = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("r", F.col("doc_id")))
    got = {r.doc_id: r for r in jaccard.similar_groups(docs, "r", "doc_id", "text", n, num, den).collect()}
    sizes, roots = plain_groups(texts, n, num, den)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert [got[i].first for i in range(len(texts))] == [i == r for i, r in enumerate(roots)]


def test_similar_groups_of_no_rows_and_null_ids(spark):
    none = cut(spark.createDataFrame([], "r long, doc_id long, text string"))
    assert jaccard.similar_groups(none, "r", "doc_id", "text").count() == 0
    rows = [(0, None, "a b c"), (1, 5, "a b c"), (2, None, None), (3, 5, "x y")]
    got = jaccard.similar_groups(cut(spark.createDataFrame(rows, "r long, doc_id long, text string")), "r", "doc_id", "text")
    assert {r.row: (r.component_id, r.first) for r in got.collect()} == {
        0: (5, False), 1: (5, True), 2: (None, True), 3: (5, True)
    }


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in got} == {x: root(x) for p in links for x in p if root(x) != x}


@pytest.mark.parametrize("split", [50_000, 1])
def test_substrings_equal_brute_force(spark, texts, monkeypatch, split):
    monkeypatch.setattr(substrings, "SPLIT_WORDS", split)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 200)
    docs = cut(spark.createDataFrame(list(enumerate(texts)), "r long, text string").withColumn("kept_", F.lit(1)).withColumn("n_Words", F.lit(2)))
    got = {r.r: r for r in substrings.remove_repeats(docs, "r", "text").collect()}
    words = [WORD.findall(t or "") for t in texts]
    seen = {}
    for i, w in enumerate(words):
        for j in range(len(w) - 34):
            seen.setdefault(tuple(w[j : j + 35]), []).append((i, j))
    gone = {(i, k) for at in seen.values() if len(at) > 1 for i, j in at for k in range(j, j + 35)}
    for i, w in enumerate(words):
        assert got[i].kept == " ".join(x for k, x in enumerate(w) if (i, k) not in gone)
        assert got[i].n_words_ == len(w)
    assert substrings.remove_repeats(docs.where("r < 0"), "r", "text").count() == 0


def test_suffix_automaton_counts():
    rng = random.Random(5)
    held = [[rng.randrange(3) for _ in range(rng.randint(4, 30))] for _ in range(20)]
    automaton = substrings.SuffixAutomaton()
    for s in held:
        automaton.add(s, 1)
    automaton.close()
    for n in (1, 3, 5):
        every = [tuple(s[i : i + n]) for s in held for i in range(len(s) - n + 1)]
        for s in held:
            assert automaton.repeats(s, n) == [every.count(tuple(s[i : i + n])) > 1 for i in range(len(s) - n + 1)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits,limit", [(1, 64), (1, 1), (2, 64), (0, 64)])
def test_lines_equal_brute_force(spark, edits, limit):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abc ") for _ in range(12)) for _ in range(4)] + ["aaaabbbbcccc", "short"]
    made = []
    for _ in range(70):
        line = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            at, kind = rng.randrange(len(line)), rng.randrange(3)
            line[at : at + (kind > 0)] = [] if kind == 2 else [rng.choice("abc")]
        made.append("".join(line))
    docs = ["\n".join(made[i : i + 5]) for i in range(0, 70, 5)] + [None, "", "\n", made[0]]
    rows = frame(spark, [(i, t, None) for i, t in enumerate(docs)])
    got = {r.doc_id: r.kept for r in lines.dedup_lines(rows, "doc_id", "text", "kept", edits, 8, limit).collect()}
    before, want = [], {}
    for i, t in enumerate(docs):
        kept = []
        for line in (t or "").split("\n"):
            gone = len(line) >= 8 and any(distance(line, b) <= edits for b in before)
            if len(line) >= 8:
                before.append(line)
            if not gone:
                kept.append(line)
        want[i] = None if t is None else kept
    assert got == want
    assert lines.dedup_lines(rows.where("doc_id < 0"), "doc_id", "text", "kept").count() == 0


def test_long_and_short_lines_equal_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefg  é") for _ in range(n)) for n in (25, 39, 60, 85, 130, 200, 330)]
    passage = base[-1][:60]
    base += [passage + "".join(rng.choice("hijk ") for _ in range(100)) for _ in range(4)]
    made = ["All rights reserved.", "}", " ", ""] * 3
    for _ in range(120):
        line = list(rng.choice(base))
        for _ in range(rng.randint(0, len(line) // 30)):
            at, kind = rng.randrange(len(line)), rng.randrange(3)
            line[at : at + (kind > 0)] = [] if kind == 2 else [rng.choice("xyz")]
        made.append("".join(line))
    rng.shuffle(made)
    docs = ["\n".join(made[i : i + 6]) for i in range(0, len(made), 6)] + [None]
    rows = frame(spark, [(i, t, None) for i, t in enumerate(docs)])
    out = lines.dedup_lines(rows, "doc_id", "text", "kept", 1, 20, 8, 40, True)
    got = {r.doc_id: r.kept for r in out.collect()}
    before, want, far = [], {}, 0
    for i, t in enumerate(docs):
        kept = []
        for line in (t or "").split("\n"):
            gone = line in before and bool(WORD.search(line))
            if not gone and len(line) >= 20:
                near = [(b, distance(line, b)) for b in before if len(b) >= 20]
                near = [d for b, d in near if d <= max(1, min(len(line), len(b)) // 40)]
                gone = bool(near)
                far += gone and min(near) > 1
            before.append(line)
            if not gone:
                kept.append(line)
        want[i] = None if t is None else kept
    assert far > 5
    assert got == want


def test_mix_is_exact(spark):
    rows = [(i, "w " * (i % 7), s) for i, s in enumerate(["a"] * 60 + ["b"] * 9 + [None] * 20 + ["empty"])]
    rows[-1] = (rows[-1][0], None, "empty")
    rows += [(3, "w w w", "a")] * 2
    sized = cut(frame(spark, rows).withColumn("size", count_words(F.col("text"))).drop("n_words"))
    got = mixing.mix(sized.select("doc_id", "source", "size"), "doc_id", "source", "size").collect()
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        t = by.setdefault(r.source, [r.target, 0, r.source_size])
        t[1] += r.taken
    assert all(taken == int(target) for target, taken, _ in by.values())
    assert abs(sum(t for t, _, _ in by.values()) - 1.5 * total) < 1e-6
    assert all(t <= 2 * s for t, _, s in by.values())
    again = mixing.mix(sized.select("doc_id", "source", "size").repartition(5), "doc_id", "source", "size").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    none = sized.where("doc_id < 0").select("doc_id", "source", "size")
    assert mixing.mix(cut(none), "doc_id", "source", "size").count() == 0
    one = spark.createDataFrame([(1, " a\tb  c ", 3, 8)], "i long, t string, size long, taken long")
    assert [r.t for r in mixing.copies(one, "t", "size", "taken").collect()] == [" a\tb  c ", " a\tb  c ", " a\tb"]


def test_quality_measures_and_bad_host(spark):
    long = " ".join(f"w{i}" for i in range(40))
    again = " ".join(f"w{i % 10}" for i in range(40))
    rows = [(1, long, "x"), (2, again, "x"), (3, None, None), (4, "", None), (5, f"{long}\n\n{long} \n{long}", "x")]
    rows += [(10 + i, "few words", "junk") for i in range(60)] + [(100, long, "junk")] + [(200 + i, long, "y") for i in range(60)]
    measured = cut(quality.measure_quality(frame(spark, rows), "text", "m"))
    got = {r.doc_id: r for r in quality.judge(measured, "source", "m", "kept").collect()}
    assert got[1].kept and got[5].m.n_lines == 3 and got[5].m.n_dup_lines == 1
    assert got[2].m.n_repeat_words == 40 and not got[2].kept
    assert got[3].m.n_words == 0 and not got[3].kept and not got[4].kept
    assert not got[100].kept and got[200].kept and got[1].n_words == 7
    none = cut(measured.where("doc_id < 0"))
    assert quality.judge(none, "source", "m", "kept").count() == 0


def test_chat_tree_takes_the_best_branch(spark):
    odd = "\\h \\### a </turn>\n### user: b\\"
    rows = [
        ("c", 1, None, "user", odd, 0.0), ("c", 2, 1, "assistant", "low", 0.1), ("c", 3, 1, "assistant", odd, 0.9),
        ("c", 4, 3, "ro:le\n", None, 0.2), ("c", 5, 4, "assistant", "", 0.0), (None, 1, 99, None, "x", 0.0),
        ("loop", 1, 2, "user", "x", 0.0), ("loop", 2, 1, "user", "x", 0.0),
    ]
    df = cut(spark.createDataFrame(rows, "conv string, msg long, parent long, role string, text string, score double"))
    out = chat.format_paths(df, "conv", "msg", "parent", "score", "role", "text")
    got = {
        r.conv: r
        for r in out.withColumns(
            {"turns": chat.read_turns(F.col("formatted")), "said": chat.read_loss(F.col("formatted"), F.col("loss"))}
        ).collect()
    }
    assert set(got) == {"c", None}
    assert [tuple(t) for t in got["c"].turns] == [("user", odd), ("assistant", odd), ("ro:le\n", ""), ("assistant", "")]
    assert got["c"].said == [odd, ""] and [tuple(t) for t in got[None].turns] == [("", "x")]
    assert chat.format_paths(df, "conv", "msg", "parent", "score", "role", "text", branches=2).where("conv = 'c'").count() == 2
    assert chat.format_paths(df.where("msg < 0"), "conv", "msg", "parent", "score", "role", "text").count() == 0


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 16)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 6)) * rng.lognormal(size=(400, 1))
    vectors[50:120] = vectors[50]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(400, None), (405, [1.0, None] * 3), (410, [float("nan")] * 6), (415, [1.0, 2.0]), (420, [0.0] * 6), (0, vectors[0].tolist())]
    df = cut(spark.createDataFrame(rows, "i long, v array<double>"))
    got = topk.top_k(df, "i", "v", F.col("id") % 5 == 0, 7).collect()
    whole = [(n, i, np.floor(64 * np.array(v)).astype(int)) for n, (i, v) in enumerate(rows)
             if v and None not in v and np.isfinite(v).all()]
    want = []
    for n, i, q in whole:
        if i % 5 == 0:
            others = sorted((-int(q @ v), j) for m, j, v in whole if m != n and len(v) == len(q))[:7]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(others)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(cut(df.where("i < 0")), "i", "v", F.col("id") % 5 == 0, 7).count() == 0


def test_toxicity_learns_words_and_their_disguises(spark):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    rows = []
    for i in range(400):
        words = rng.choices(vocab, k=40)
        if i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(["blockhead", "dimwit"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    df = cut(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    model = toxicity.train(df.where("doc_id < 300"), "text", "toxic")
    asked = [(1, "you blockhead"), (2, "you b.l.o.c.k.h.e.a.d"), (3, "b l o c k h e a d"), (4, "blockxhead"),
             (5, " ".join(vocab[:30])), (6, None), (7, ""), (7, "")]
    asked = spark.createDataFrame(asked, "i long, t string").withColumn("score_", F.lit(1))
    got = {r.i: r.score for r in toxicity.score(asked, "t", model, "score").collect()}
    assert min(got[i] for i in (1, 2, 3)) > 0.5 > max(got[i] for i in (5, 6, 7))
    # A letter put in costs some certainty, but such a word still stands out from clean texts.
    assert got[4] > 5 * max(got[i] for i in (5, 6, 7))
    held = toxicity.score(df.where("doc_id >= 300"), "text", model, "s").collect()
    assert np.mean([(r.s >= 0.5) == bool(r.toxic) for r in held]) > 0.95
    nothing = toxicity.train(df.where("toxic = 0"), "text", "toxic")
    assert toxicity.score(asked, "t", nothing, "s").agg(F.max("s")).first()[0] < 1e-9


def test_main_text():
    menu = "<nav><ul><li><a href=x>Menu</a></li></ul></nav>"
    body = "".join(f"<p>Sentence {i}, with marks, and &amp; more.<br> End.</p>" for i in range(5))
    page = f"""<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>{menu}
    <header><h1>Site</h1></header><div class="ad">Buy, now, this.</div><article><h1 data-x="a > b">Head</h1>{body}
    <p><b>Bold text, unclosed.<p>Short<form>Send</form><ul><li>one<li>two</ul><!-- no -->
    <section id="comments"><p>I say, this, is, a comment.</p></section></article>
    <aside>Side, text.</aside><footer>&copy; Foot.</footer></body></html>"""
    want = ["Head", *[f"Sentence {i}, with marks, and & more. End." for i in range(5)], "Bold text, unclosed.", "Short", "one", "two"]
    assert pages.main_text(page).split("\n") == want
    assert [pages.main_text(x) for x in (None, "", "<p", "<!-- a", "<script>x")] == [""] * 5
    assert pages.main_text("plain words") == "plain words"
    loose = "<body><div class=menu>a, b</div><div><p>One, two, three.</p><p>Four, five.</p></div><div><a href=x>link</a></div>"
    assert pages.main_text(loose) == "One, two, three.\nFour, five."


def test_names_decide_as_whole_words():
    for name in ("page has-sidebar", "no-comments", "post-share-enabled", "with-widget", "sidebar"):
        page = f"<body><div class='{name}'><article><p>One, two.</p></article></div></body>"
        assert pages.main_text(page) == "One, two."
        assert pages.main_text(f"<div class='{name}'><p>One, two.</p><p>Three.</p></div><p>No</p>").startswith("One, two.")
    body = "<article><p>One, two.</p><p>Three, four.</p></article>"
    for name in ("sidebar", "comment-list", "site-footer", "adSlot", "box share-buttons"):
        assert pages.main_text(f"{body}<div class='{name}'><article><p>Much, much, more.</p></article></div>") == (
            "One, two.\nThree, four."
        )
    assert pages.main_text("<div class=menu>x</div><div>Kept, here.</div>") == "Kept, here."


def test_blocks_without_marks():
    page = "<div><p>A, b.</p><ul><li>apples<li>pears</ul><p>C, d.</p></div>"
    assert pages.main_text(page) == "A, b.\napples\npears\nC, d."
    assert pages.main_text("<div><p>First, one.</p><pre>a b</pre><p>Last, one.</p></div><div><ul><li><a href=x>Link</a></ul></div>") == (
        "First, one.\na b\nLast, one."
    )
    part = "<p>Some words, some more.</p>"
    assert pages.main_text(f"<article>{part}</article><div>{part}</div>").count("Some") == 2
    assert pages.main_text("<ul><li>a plain line as long as others</ul><p>A line, as long as the others.</p>").count("\n") == 1


def test_pages_table(spark):
    rows = spark.createDataFrame([(1, None), (2, "<p>a, b.</p>"), (2, "<p>a, b.</p>")], "page_id long, html string")
    got = pages.extract_main_text(rows, "html", "text").collect()
    assert [r.text for r in got] == ["", "a, b.", "a, b."]
    assert json.dumps([r.page_id for r in got]) == "[1, 2, 2]"
