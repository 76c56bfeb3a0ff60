import math
import random
import re

import pytest
from pyspark.sql import functions as F

from topicloom.functions import arrays, html, labels, text
from topicloom.operators.frontier import page_numbers
from topicloom.settings import DEFAULT_LAYOUT, Selector


def one(spark, schema, value, *cols):
    row = spark.createDataFrame([(value,)], schema).select(*cols).first()
    return row[0] if len(cols) == 1 else tuple(row)


TEXTS = [
    "Hello, World!  It's   fine",
    "snake_case ½ a b éte ПРИВЕТ, мир…",
    "\x1c x \x85 y z",
    "",
    "  ... !!! ",
    "Ünïcödé ١٢٣ 漢字かな 𝒳",
]


@pytest.mark.parametrize("s", TEXTS)
def test_tokenize_is_the_unicode_word_split(spark, s):
    want = re.sub(r"[^\w\s]", "", s.lower()).split()
    assert one(spark, "t string", s, text.tokenize(F.col("t"))) == want
    assert one(spark, "t string", s, text.normalize(F.col("t"))) == " ".join(want)


@pytest.mark.parametrize("s", TEXTS)
def test_tokenize_punct_keeps_marks(spark, s):
    want = re.findall(r"\w+|[^\w\s]", s.lower())
    assert one(spark, "t string", s, text.tokenize_punct(F.col("t"))) == want


def test_contractions_are_optional(spark):
    s = "You cannot; gonna wannabe"
    assert one(spark, "t string", s, text.tokenize(F.col("t"))) == ["you", "cannot", "gonna", "wannabe"]
    got = one(spark, "t string", s, text.tokenize(F.col("t"), text.CONTRACTIONS))
    assert got == ["you", "can", "not", "gon", "na", "wannabe"]


def test_preview(spark):
    assert one(spark, "t string", "a" * 200, text.preview(F.col("t"))) == "a" * 200
    assert one(spark, "t string", "a" * 201, text.preview(F.col("t"))) == "a" * 200 + "..."


def test_null_text_stays_null(spark):
    assert one(spark, "t string", None, text.tokenize(F.col("t"))) is None


@pytest.mark.parametrize(
    "value, want",
    [
        ("*Hub *|Блог компании X| Python |блог", ["Hub", "Python"]),
        ("a|a|b", ["a", "a", "b"]),
        (" * Name * ", ["Name"]),
        ("", []),
        (None, []),
        ("Без тегов", ["Без тегов"]),
    ],
)
def test_clean_labels(spark, value, want):
    assert one(spark, "t string", value, labels.clean_labels(F.col("t"))) == want


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://x/ru/articles/123/", 123),
        ("/ru/articles/9/articles/10", 9),
        ("https://x/ru/news/123/", None),
        (None, None),
        ("/articles/99999999999999999999", None),
    ],
)
def test_article_id(spark, url, want):
    assert one(spark, "t string", url, labels.article_id(F.col("t"))) == want


def test_fix_names(spark):
    got = one(spark, "t array<string>", ["Распределенные системы", "SQL"], labels.fix_names(F.col("t")))
    assert got == ["Распределённые системы", "SQL"]


@pytest.mark.parametrize(
    "seq, want", [([1, 2], [1, 2, 0, 0]), ([1, 2, 3, 4, 5], [1, 2, 3, 4]), ([], [0, 0, 0, 0])]
)
def test_pad(spark, seq, want):
    assert one(spark, "t array<int>", seq, arrays.pad(F.col("t"), 4)) == want


def test_softmax_argmax_loss(spark):
    big = [1000.0, 1001.0, 999.0]
    p = one(spark, "t array<double>", big, arrays.softmax(F.col("t")))
    assert abs(sum(p) - 1) < 1e-12 and p[1] == max(p)
    assert one(spark, "t array<double>", [2.0, 5.0, 5.0], arrays.argmax(F.col("t"))) == 1
    assert one(spark, "t array<double>", [], arrays.argmax(F.col("t"))) == -1
    loss = one(spark, "t array<double>", [1.0, 2.0, 3.0], arrays.log_loss(F.col("t"), F.lit(0)))
    assert abs(loss - (math.log(sum(math.exp(x) for x in (1, 2, 3))) - 1)) < 1e-12


def test_multi_hot(spark):
    assert one(spark, "t array<int>", [0, 2], arrays.multi_hot(F.col("t"), 4)) == [1, 0, 1, 0]


PAGE = """<html><head><meta content="ai, big data ,sql&amp;x" name="keywords"><script>var a = "<h1>no</h1>";</script></head>
<body><h1 class="tm-title tm-title_h1"><span>It's &lt;b&gt; &#1055;&#x41;&nbsp;&unknown; &amp;lt;</span></h1>
<time datetime="x" title='2024-01-02, 10:00'>now</time><time title="later"></time>
<span class="tm-publication-hub__link-container"><a><span>Hub A</span><span> *</span></a></span>
<span class="other tm-publication-hub__link-container"><span>Hub B</span></span>
<span class="tm-publication-hub__link-container-x">no</span>
<div class="w"><div id="post-content-body"><div><p>one<!-- <p>hidden</p> --> two</p><div>three</div></div>four<style>p{}</style></div>five</div>
<a class="tm-title__link" href="/ru/articles/1/">x</a><a href="/no">y</a><a data-x="1" class="a tm-title__link b" href='/ru/articles/2/?a=1&amp;b=2'>z</a>
<a class="tm-pagination__page" href="/ru/hubs/x/articles/page2/">2</a><a class="tm-pagination__page" href="/ru/hubs/x/page12/">12</a>
</body></html>"""


def test_page_fields(spark):
    page = html.visible(F.col("t"))
    lay = DEFAULT_LAYOUT
    assert one(spark, "t string", PAGE, html.element_text(page, lay.title)) == (
        "It's <b> ПA &unknown; &lt;"
    )
    assert one(spark, "t string", PAGE, html.element_text(page, lay.body)) == "one twothreefour"
    assert one(spark, "t string", PAGE, html.element_texts(page, lay.hubs)) == ["Hub A *", "Hub B"]
    assert one(spark, "t string", PAGE, html.attr_value(page, lay.tags, "content")) == "ai, big data ,sql&x"
    assert one(spark, "t string", PAGE, html.attr_value(page, lay.date, "title")) == "2024-01-02, 10:00"
    assert one(spark, "t string", PAGE, html.attr_values(page, lay.link, "href")) == [
        "/ru/articles/1/", "/ru/articles/2/?a=1&b=2"
    ]
    hrefs = html.attr_values(page, lay.pager, "href")
    assert one(spark, "t string", PAGE, page_numbers(hrefs)) == [2, 12]


def test_missing_elements(spark):
    page = "<p>nothing</p>"
    for c in (
        html.element_text(F.col("t"), DEFAULT_LAYOUT.body),
        html.attr_value(F.col("t"), DEFAULT_LAYOUT.date, "title"),
    ):
        assert one(spark, "t string", page, c) is None
    assert one(spark, "t string", page, html.element_texts(F.col("t"), DEFAULT_LAYOUT.hubs)) == []


def test_hidden_text(spark):
    page = "a<!-- x --><ruby>b<rp>(</rp><rt>c<rp>)</ruby><STYLE>s</style >d<template><p>t</p></template>e<script>f"
    assert one(spark, "t string", page, html.strip_tags(html.visible(F.col("t")))) == "abde"


def test_unclosed_element_runs_to_the_end(spark):
    page = "<article><b>x<p>y"
    assert one(spark, "t string", page, html.element_text(F.col("t"), Selector("article"))) == "xy"


def test_sentences(spark):
    got = one(spark, "t string", "One two. Three! \nFour?? five", text.sentences(F.col("t")))
    assert got == ["One two.", "Three!", "Four??", "five"]


def test_large_page(spark):
    inner = "<div>x&amp;</div><script>a</script>" * 30000
    page = f'<div id="post-content-body">{inner}</div>' + "<script>" * 2000 + "y" * 1000000
    df = spark.createDataFrame([(page,)], "t string").select(html.visible(F.col("t")).alias("t"))
    assert df.select(html.element_text(F.col("t"), DEFAULT_LAYOUT.body)).first()[0] == "x&" * 30000


def test_references_and_quoted_signs(spark):
    page = '<h1 data-x="a > b">Rock &apos;n&apos; roll &#00000039; &#x0000027;</h1><p t=\'>\'>x</p>'
    df = spark.createDataFrame([(page,)], "p string")
    got = df.select(html.element_text(F.col("p"), Selector("h1")), html.strip_tags(F.col("p"))).first()
    assert tuple(got) == ("Rock 'n' roll ' '", "Rock 'n' roll ' 'x")


# --- elements as intervals ---------------------------------------------------

VOID = {"br", "img"}
NEXT = {"p", "li"}
SCOPES = {"div", "ul"}


def plain_texts(page, chain):
    """Texts of the elements of class ``chain[-1]`` inside those of the classes before it, by a stack."""
    parts = re.findall(r"</?[a-z]+(?: class=[a-z])?/?>[^<]*", page)
    texts = [re.sub(r"^<[^>]*>", "", t) for t in parts]
    stack, done = [], []

    def end(many, i):
        for _ in range(many):
            name, first, cls = stack.pop()
            done.append((first, i, cls))

    for i, part in enumerate(parts):
        closes, name, cls, alone = re.match(r"<(/?)([a-z]+)(?: class=([a-z]))?(/?)>", part).groups()
        names = [s[0] for s in reversed(stack)]
        at = names.index(name) + 1 if name in names else 0
        fences = [k for k, n in enumerate(names, 1) if n in SCOPES]
        if closes or name in NEXT and (not fences or at < fences[0]):
            end(at, i)
        if not closes:
            if alone or name in VOID:
                done.append((i, i, cls))
            else:
                stack.append((name, i, cls))
    end(len(stack), len(parts))
    kept = [s for s in sorted(done) if s[2] == chain[0]]
    for cls in chain[1:]:
        kept = [s for s in sorted(done) if s[2] == cls and any(o[0] < s[0] and s[1] <= o[1] for o in kept)]
    return ["".join(texts[a:b]) for a, b, _ in kept]


def random_page(rng):
    out = []
    for i in range(rng.randrange(0, 60)):
        name = rng.choice(["div", "span", "p", "li", "ul", "br", "b"])
        kind = rng.random()
        cls = rng.choice(["", "", " class=h", " class=k"])
        out.append(f"</{name}>" if kind < 0.4 else f"<{name}{cls}>")
        out.append(rng.choice(["", f"t{i}", " "]))
    return "".join(out)


@pytest.mark.parametrize("chunk", [128, 3])
def test_element_texts_equal_a_plain_stack(spark, monkeypatch, chunk):
    monkeypatch.setattr(html, "_CHUNK", chunk)
    rng = random.Random(chunk)
    pages = [random_page(rng) for _ in range(150)]
    pages.append("<div class=h>" + "<span class=k>x" * 700)
    sels = {c: [Selector("[a-z]+", "class", x) for x in c] for c in ("h", "k", "hk", "hkh")}
    df = spark.createDataFrame(list(enumerate(pages)), "i int, t string")
    got = df.select("i", *[html.element_texts(F.col("t"), *s).alias(c) for c, s in sels.items()]).collect()
    for r in got:
        assert {c: r[c] for c in sels} == {c: plain_texts(pages[r.i], c) for c in sels}, pages[r.i]


def test_nested_matches_keep_their_whole_text(spark):
    h = Selector("span", "class", "h")
    cases = {
        "<span class=h>a<span class=h>b</span>c</span>": ["abc", "b"],
        "<div><span class='x h'>a</div>b": ["a"],
        "<span class=h title='a>b'>1 < 2 &amp; 3</span>": ["1 < 2 & 3"],
        "<SPAN CLASS=\"h\">x<br/>y": ["xy"],
        "<span class=h>a &amp; b</span><p><span class=h></SPAN >": ["a & b", ""],
        "<span class=h />b</span><span class=h>c</span>": ["", "c"],
        "<b>no</b>": [], "": [], None: None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.x for r in df.select("t", html.element_texts(F.col("t"), h).alias("x")).collect()} == cases
