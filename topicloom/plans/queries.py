"""Every operator as a query over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import arrays, html, labels, text
from topicloom.operators import (
    approximate, asof, classify, clean, extract, folds, frontier, joins, metrics, ranking, similar, split, summary, vocab,
)
from topicloom.plans import corpus, training
from topicloom.runtime import cut, scratch, spread
from topicloom.settings import NO_TEXT, SERVE_MAX_LEN, UNK, Layout, Selector
from topicloom.sources import tables, vocab_json
from topicloom.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# The layout of the given pages, which differs from the default one.
SITE = Layout(
    body=Selector("article"), title=Selector("h1"), hubs=Selector("a"), link=Selector("a"),
    pager=Selector("a"),
)
SITE_HOST = "https://site.example"
SITE_ID = r"/[a-z]{2}/([0-9]+)"
TOPIC = "lang"


def query(fn):
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def _table(name: str, heavy: bool = False):
    def read(spark: SparkSession, sf: str) -> DataFrame:
        df = tables.read_table(spark, sf, name)
        return spread(df) if heavy else df

    return read


_documents, _pages, _talks = (_table(n, heavy=True) for n in ("documents", "pages", "conversations"))
_embeddings, _marks, _events = (_table(n) for n in ("embeddings", "labels", "events"))


def _hub() -> Column:
    return F.regexp_extract("url", r"//[^/]+/([a-z]{2})/", 1)


def _tokens(col: str = "text") -> Column:
    return text.tokenize(F.col(col))


def _joined(c: Column, sep: str = " ") -> Column:
    return F.array_join(c, sep)


def _vocab(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.build_vocab(_documents(spark, sf), "doc_id", _tokens())


def _articles(spark: SparkSession, sf: str, layout: Layout = SITE) -> DataFrame:
    return extract.extract_articles(_pages(spark, sf), _hub(), layout, keep=("page_id",))


def _decorated(spark: SparkSession, sf: str) -> DataFrame:
    """Articles whose hubs carry spaces and marks, as a site prints them."""
    marked = F.array_join(
        F.transform(F.split("hubs", r"\|"), lambda h: F.concat(F.lit(" *"), h, F.lit("* "))), "|"
    )
    return _articles(spark, sf).withColumn("hubs", marked)


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.page_links(
        _pages(spark, sf).select("page_id", _hub().alias("hub"), "html"),
        ["page_id", "hub"], host=SITE_HOST, link=SITE.link,
    )


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """URLs already stored: those that English pages link to."""
    return _links(spark, sf).where("hub = 'en'").select("url").distinct()


def _hubs(spark: SparkSession, sf: str) -> DataFrame:
    hubs = _pages(spark, sf).select(_hub().alias("hub")).distinct()
    return ranking.dense_index(hubs, ["hub"], "ord", 0)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Logits and labels: all values of a vector, the label as one of its places."""
    return _embeddings(spark, sf).select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("logits"),
        F.col("label").alias("cluster"),
        F.pmod("label", F.size("embedding")).alias("label"),
    ).withColumn("pred", arrays.argmax(F.col("logits")))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn as candidate with the turn before it as reference."""
    talk = _talks(spark, sf)
    before = talk.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("ref"))
    return talk.join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn", _tokens().alias("cand"), _tokens("ref").alias("ref")
    )


# --- sources and sinks -------------------------------------------------------


@query
def csv_roundtrip(spark, sf):
    path = scratch(spark, "csv")
    tables.write_csv(_documents(spark, sf).select("doc_id", "lang", "source", "text"), path)
    schema = "doc_id bigint, lang string, source string, text string"
    return tables.read_csv(spark, path, tables.T._parse_datatype_string(schema))


@query
def pages_scan(spark, sf):
    return extract.fetched(_pages(spark, sf)).select(
        "page_id", "url", _hub().alias("hub"), F.length("html").cast("bigint").alias("n_chars")
    )


@query
def docs_by_category(spark, sf):
    path = scratch(spark, "by-category")
    tables.write_by_category(_articles(spark, sf), path)
    stored = spark.read.schema("page_id bigint, url string, title string, category string").parquet(path)
    return stored.select("page_id", "category", "url", "title")


@query
def extract_errors(spark, sf):
    return extract.extract_errors(_pages(spark, sf), SITE)


@query
def vocab_json_(spark, sf):
    path = scratch(spark, "vocab")
    vocab_json.write_vocab_json(_vocab(spark, sf), path)
    return vocab_json.read_vocab_json(spark, path)


# --- frontier ----------------------------------------------------------------


def _last_pages(spark, sf):
    anchors = F.coalesce(frontier.pager_links(F.col("html"), SITE.pager), F.array().cast("array<string>"))
    return frontier.last_page(
        _pages(spark, sf), _hub(), F.concat(anchors, F.array("url")), r"[?&]page=([0-9]+)"
    )


@query
def last_page(spark, sf):
    return _last_pages(spark, sf)


@query
def hub_frontier(spark, sf):
    template = SITE_HOST + "/hubs/%s/articles/page%d/"
    return frontier.page_urls(_hubs(spark, sf).select("hub"), _last_pages(spark, sf), 20, template)


@query
def page_links(spark, sf):
    return _links(spark, sf).select("page_id", F.col("pos").cast("bigint").alias("pos"), "url")


@query
def new_links_anti(spark, sf):
    order = [F.col("page_id"), F.col("pos")]
    fresh = frontier.new_links(_links(spark, sf), _stored(spark, sf), order)
    return fresh.select("url", "hub", "page_id")


@query
def dedupe_url(spark, sf):
    first = ranking.first_per_key(_links(spark, sf), "url", [F.col("page_id"), F.col("pos")])
    return first.select("url", "hub", "page_id", F.col("pos").cast("bigint").alias("pos"))


@query
def hub_resume(spark, sf):
    return frontier.resume_from(_hubs(spark, sf), "es").select("hub", "ord")


@query
def hubs_without_links(spark, sf):
    order = [F.col("page_id"), F.col("pos")]
    fresh = frontier.new_links(_links(spark, sf), _stored(spark, sf), order)
    return frontier.hubs_without_links(_hubs(spark, sf).select("hub"), fresh)


@query
def link_report(spark, sf):
    links = _links(spark, sf)
    fresh = frontier.new_links(links, _stored(spark, sf), [F.col("page_id"), F.col("pos")])
    return frontier.link_report(_hubs(spark, sf).select("hub"), links, fresh)


@query
def ingest_counts(spark, sf):
    return clean.clean_counts(_articles(spark, sf), id_pattern=r"/(?:en|fr)/([0-9]+)")


# --- extraction --------------------------------------------------------------


@query
def article_text(spark, sf):
    return _articles(spark, sf).select("page_id", "text")


@query
def article_title(spark, sf):
    return _articles(spark, sf).select("page_id", "title")


@query
def article_hubs(spark, sf):
    return _articles(spark, sf).select("page_id", "hubs")


@query
def article_paragraphs(spark, sf):
    """Every paragraph inside the body: a paragraph without end tag ends where the next one begins."""
    found = html.element_texts(html.visible(F.col("html")), SITE.body, Selector("p"))
    rows = extract.fetched(_pages(spark, sf)).select("page_id", F.posexplode(found).alias("pos", "text"))
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), "text")


@query
def article_tags(spark, sf):
    layout = Layout(
        SITE.body, SITE.title, SITE.hubs, Selector("meta", "charset", "utf-8", exact=True), "charset"
    )
    found = _articles(spark, sf, layout).select("page_id", "tags")
    none = _articles(spark, sf).select("page_id", F.col("tags").alias("tags_missing"))
    return found.join(none, "page_id")


@query
def article_date(spark, sf):
    layout = Layout(SITE.body, SITE.title, SITE.hubs, date=Selector("html"), date_attr="lang")
    found = _articles(spark, sf, layout).select("page_id", "date")
    none = _articles(spark, sf).select("page_id", F.col("date").alias("date_missing"))
    return found.join(none, "page_id")


@query
def articles(spark, sf):
    return _articles(spark, sf).select(*extract.ARTICLE_COLUMNS)


# --- cleaning ----------------------------------------------------------------


@query
def drop_no_text(spark, sf):
    docs = _documents(spark, sf).withColumn(
        "text", F.when(F.col("lang") == "es", F.lit(NO_TEXT)).when(F.col("lang") != "fr", F.col("text"))
    )
    return docs.where(clean.has_text(F.col("text"))).select("doc_id", "lang", "text")


@query
def clean_hubs(spark, sf):
    hubs = labels.clean_labels(F.col("hubs"), blocked_prefix="the")
    return _decorated(spark, sf).select("page_id", _joined(hubs, "|").alias("hubs"))


@query
def clean_tags(spark, sf):
    return _decorated(spark, sf).select(
        "page_id", _joined(labels.clean_labels(F.col("hubs")), "|").alias("tags")
    )


@query
def article_id(spark, sf):
    return (
        _pages(spark, sf)
        .select("page_id", labels.article_id(F.col("url"), SITE_ID).alias("doc_id"))
        .where(F.col("doc_id").isNotNull())
    )


@query
def fix_hub_names(spark, sf):
    hubs = labels.clean_labels(F.col("hubs"), blocked_prefix="the")
    rules = ((r"th.+ble", "Thable"),)
    return _decorated(spark, sf).select(
        "page_id", _joined(labels.fix_names(hubs, rules), "|").alias("hubs")
    )


def _clean_rules() -> dict:
    return {"blocked_prefix": "the", "id_pattern": SITE_ID, "rules": ((r"th.+ble", "Thable"),)}


def _flat(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "category", "url", "title", "text", _joined(F.col("hubs"), "|").alias("hubs"),
        _joined(F.col("tags"), "|").alias("tags"),
    )


@query
def clean_documents(spark, sf):
    return _flat(corpus.build_corpus(_pages(spark, sf), _hub(), SITE, **_clean_rules()))


# --- text --------------------------------------------------------------------


@query
def normalize_text(spark, sf):
    return _documents(spark, sf).select("doc_id", text.normalize(F.col("text")).alias("text"))


@query
def tokenize(spark, sf):
    return _talks(spark, sf).select("conv_id", "turn", _joined(_tokens(), "|").alias("tokens"))


@query
def tokenize_punct(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", _joined(text.tokenize_punct(F.col("text"))).alias("tokens")
    )


@query
def token_rows(spark, sf):
    rows = vocab.token_rows(_documents(spark, sf), ["doc_id"], _tokens())
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


@query
def text_preview(spark, sf):
    return _documents(spark, sf).select("doc_id", text.preview(F.col("text")).alias("preview"))


@query
def doc_lengths(spark, sf):
    return _documents(spark, sf).select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.size(_tokens()).cast("bigint").alias("n_tokens"),
    )


# --- vocabulary, encoding, labels --------------------------------------------


@query
def token_counts(spark, sf):
    return vocab.token_counts(vocab.token_rows(_documents(spark, sf), ["doc_id"], _tokens()))


@query
def vocab_index(spark, sf):
    return _vocab(spark, sf)


@query
def encode_tokens(spark, sf):
    docs = _documents(spark, sf)
    words = vocab.build_vocab(docs, "doc_id", _tokens())
    return vocab.encode(docs, ["doc_id"], _tokens(), words, counted=True).select(
        "doc_id", "n_tokens", "unk_rate", _joined(F.col("seq").cast("array<string>")).alias("seq")
    )


@query
def unk_rate(spark, sf):
    coded = vocab.encode(_talks(spark, sf), ["conv_id", "turn"], _tokens(), _vocab(spark, sf))
    return coded.select("conv_id", "turn", "n_tokens", "n_unk", F.round("unk_rate", 9).alias("unk_rate"))


@query
def pad_sequences(spark, sf):
    coded = vocab.encode(_talks(spark, sf), ["conv_id", "turn"], _tokens(), _vocab(spark, sf))
    seq = arrays.pad(F.col("seq"), SERVE_MAX_LEN)
    return coded.select(
        "conv_id", "turn", F.size(seq).cast("bigint").alias("n"),
        _joined(seq.cast("array<string>")).alias("seq"),
    )


@query
def vocab_ensure_unk(spark, sf):
    known = _vocab(spark, sf).where(F.col("token") != UNK).select("token", "idx")
    return vocab.ensure_unk(known)


@query
def vocab_size(spark, sf):
    return vocab.vocab_size(_vocab(spark, sf))


@query
def label_index(spark, sf):
    return training.with_targets(_documents(spark, sf).select("doc_id", "lang"), TOPIC)


@query
def label_remap(spark, sf):
    shifted = _embeddings(spark, sf).select("vec_id", (F.col("label") + 1).alias("label"))
    return vocab.remap_max_label(shifted, "label", vocab.max_label(shifted, "label"))


@query
def multi_hot(spark, sf):
    hubs = F.split("hubs", r"\|")
    sets = vocab.label_sets(_articles(spark, sf), ["page_id"], hubs)
    return sets.select("page_id", _joined(F.col("targets").cast("array<string>")).alias("targets"))


@query
def multi_hot_dense(spark, sf):
    """Zero/one targets of the quality and toxic marks."""
    sets = vocab.label_sets(_marks(spark, sf), ["doc_id"], F.array_compact(F.array(*_mark_names())))
    hot = arrays.multi_hot(F.col("targets"), 2)
    return sets.select("doc_id", _joined(hot.cast("array<string>"), "").alias("hot"))


@query
def class_balance(spark, sf):
    return vocab.class_balance(_documents(spark, sf), TOPIC).withColumn("share", F.round("share", 9))


# --- splits ------------------------------------------------------------------


@query
def stratified_split(spark, sf):
    docs = _documents(spark, sf).select("doc_id", "lang")
    return split.stratified_split(docs, "doc_id", TOPIC)


@query
def val_split(spark, sf):
    return split.exact_split(_documents(spark, sf).select("doc_id", "lang"), "doc_id")


@query
def prepared_dataset(spark, sf):
    docs = training.with_targets(_documents(spark, sf).select("doc_id", "lang", "text"), TOPIC)
    got = training.prepare(docs, "doc_id", "text", "target", fit_on="train")
    return got.rows.select(
        "doc_id", "target", "part", _joined(F.col("seq").cast("array<string>")).alias("seq")
    )


# --- scoring and models ------------------------------------------------------


@query
def softmax(spark, sf):
    p = arrays.softmax(F.col("logits"))
    return _scored(spark, sf).select("vec_id", F.posexplode(p).alias("pos", "p")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("p", 6).alias("p")
    )


@query
def argmax_class(spark, sf):
    return _scored(spark, sf).select("vec_id", "pred")


def _response(scored: DataFrame, ids: list[str], classes: list) -> DataFrame:
    """One row per text and class of the model; a text that could not be scored has one without class."""
    each = F.posexplode_outer(F.arrays_zip("class_probabilities", "logits")).alias("_at", "_class")
    name = F.get(F.array(*[F.lit(c) for c in classes]), F.col("_at"))
    rows = scored.select(*ids, "text", "preprocessed_text", "predicted_class", "error", each)
    return rows.select(
        *ids, "text", "preprocessed_text", F.col("predicted_class").cast("bigint").alias("predicted_class"),
        name.alias("class"), F.round("_class.class_probabilities", 6).alias("p"),
        F.round("_class.logits", 4).alias("logit"), "error",
    )


@query
def score_documents(spark, sf):
    model = training.train(_documents(spark, sf), TOPIC)
    ids = ["conv_id", "turn"]
    return _response(classify.score_documents(_talks(spark, sf), ids, model), ids, model.classes)


@query
def train_topic_model(spark, sf):
    model = training.train(_documents(spark, sf), TOPIC)
    rows = model.weights.select("token", F.posexplode("w").alias("_at", "w"))
    return rows.select("token", model.class_name(F.col("_at")).alias("class"), F.round("w", 6).alias("w"))


@query
def evaluate_model(spark, sf):
    train, test = training.train_test(_documents(spark, sf), "doc_id", TOPIC)
    path = scratch(spark, "model")
    training.train(train, TOPIC).save(path)
    model = classify.TokenBayes.load(spark, path)
    return training.evaluate(model, test, "doc_id", TOPIC).select(
        "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "loss")]
    )


@query
def model_choice(spark, sf):
    docs = _documents(spark, sf).select("doc_id", "lang", _tokens().alias("tokens"))
    train, val = training.train_test(docs, "doc_id", TOPIC)
    return classify.choose_model(train, val, TOPIC, classify.model_kinds())


@query
def multilabel_baseline(spark, sf):
    marks = _marks(spark, sf)
    docs = _documents(spark, sf).join(marks, "doc_id").select(
        "doc_id", "quality", "toxic", "lang", _tokens().alias("tokens")
    )
    train, test = training.train_test(docs, "doc_id", TOPIC)
    names = ["quality", "toxic"]
    pred = classify.multilabel_baseline(train, test, ["doc_id"], names)
    truth = _label_pairs(test)
    return metrics.multilabel_f1(truth, pred, ["doc_id"])


@query
def model_choice_folds(spark, sf):
    """Smoothing values of naive Bayes by the loss on folds that a model has not seen."""
    found = folds.choose_smoothing(_documents(spark, sf), "doc_id", TOPIC, _tokens())
    return found.select("smoothing", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "loss")])


@query
def multilabel_bayes(spark, sf):
    """One naive Bayes per mark, fitted on four fifths of the marked texts and judged on the rest."""
    docs = _documents(spark, sf).join(_marks(spark, sf), "doc_id").select(
        "doc_id", "quality", "toxic", _tokens().alias("tokens"), folds.fold_of("doc_id").alias("fold")
    )
    train, test = cut(docs.where("fold <> 0")), cut(docs.where("fold = 0"))
    model = folds.fit_label_bayes(train, F.array_compact(F.array(*_mark_names())), F.col("tokens"))
    pred = folds.predict_labels(test, ["doc_id"], model, F.col("tokens"))
    return _rates(metrics.multilabel_f1(_label_pairs(test), pred, ["doc_id"]), "label", "tp", "fp", "fn")


@query
def last_seen_value(spark, sf):
    """For every event the latest view of its user up to then."""
    events = _events(spark, sf)
    views = events.where("event_type = 'view'").select("user_id", "ts", "event_id", "value")
    return asof.asof_join(
        events.select("event_id", "user_id", "ts"), views, "user_id", "ts", "event_id",
        {"event_id": "view_id", "value": "view_value"},
    )


@query
def best_runs_topk(spark, sf):
    runs = _events(spark, sf).select(
        F.col("event_id").alias("run_id"), F.col("value").alias("val_loss")
    )
    return metrics.best_runs(runs, "val_loss", 5, "run_id")


# --- metrics -----------------------------------------------------------------


@query
def accuracy(spark, sf):
    return metrics.accuracy(_scored(spark, sf)).select(F.round("accuracy", 9).alias("accuracy"))


@query
def macro_f1(spark, sf):
    return metrics.macro_f1(_scored(spark, sf)).select(F.round("macro_f1", 9).alias("macro_f1"))


@query
def cross_entropy(spark, sf):
    return metrics.cross_entropy(_scored(spark, sf)).select(F.round("loss", 9).alias("loss"))


@query
def confusion_matrix(spark, sf):
    return metrics.confusion(_scored(spark, sf))


def _rates(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def rouge_1(spark, sf):
    found = metrics.rouge_n(_turns(spark, sf), ["conv_id", "turn"], "cand", "ref", 1)
    return _rates(found, "conv_id", "turn", "overlap")


@query
def rouge_2(spark, sf):
    found = metrics.rouge_n(_turns(spark, sf), ["conv_id", "turn"], "cand", "ref", 2)
    return _rates(found, "conv_id", "turn", "overlap")


@query
def rouge_l(spark, sf):
    found = metrics.rouge_l(_turns(spark, sf), ["conv_id", "turn"], "cand", "ref")
    return _rates(found, "conv_id", "turn", "overlap")


@query
def v_measure(spark, sf):
    return metrics.v_measure(_scored(spark, sf), "cluster", "pred").select(
        *[F.round(c, 9).alias(c) for c in ("homogeneity", "completeness", "v_measure")]
    )


def _similar(spark, sf):
    vectors = _embeddings(spark, sf)
    return similar.top_k_similar(vectors, vectors, 5)


@query
def precision_recall_at_k(spark, sf):
    own = _embeddings(spark, sf).select("vec_id", "label")
    sizes = own.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    relevant = joins.lookup_join(own, sizes, "label").select(
        F.col("vec_id").alias("query_id"), "n_relevant"
    )
    ranked = joins.lookup_join(
        _similar(spark, sf), own.toDF("query_id", "query_label"), "query_id"
    )
    ranked = joins.lookup_join(ranked, own.toDF("item_id", "item_label"), "item_id")
    ranked = ranked.withColumn("hit", F.col("query_label") == F.col("item_label"))
    return metrics.precision_recall_at_k(ranked, relevant, 5).select(
        "n_queries", F.round("precision_at_k", 9).alias("precision_at_k"),
        F.round("recall_at_k", 9).alias("recall_at_k"),
    )


def _mark_names() -> list[Column]:
    return [F.when(F.col(n) == 1, F.lit(n)) for n in ("quality", "toxic")]


def _label_pairs(df: DataFrame) -> DataFrame:
    names = F.array_compact(F.array(*_mark_names()))
    return df.select("doc_id", F.explode(names).alias("label"))


@query
def multilabel_f1(spark, sf):
    truth = _label_pairs(_marks(spark, sf))
    docs = _documents(spark, sf).join(_marks(spark, sf).select("doc_id"), "doc_id", "left_semi")
    pred = _label_pairs(
        docs.select(
            "doc_id",
            (F.col("n_chars") > 500).cast("int").alias("quality"),
            F.rlike("text", F.lit("[0-9]")).cast("int").alias("toxic"),
        )
    )
    return _rates(metrics.multilabel_f1(truth, pred, ["doc_id"]), "label", "tp", "fp", "fn")


@query
def epoch_metrics(spark, sf):
    steps = _events(spark, sf).select(
        F.hour("ts").cast("bigint").alias("epoch"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("train_loss"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("val_loss"),
    )
    means = metrics.epoch_metrics(steps, "epoch", ["train_loss", "val_loss"])
    return means.select(
        "epoch", "steps", *[F.round(c, 6).alias(c) for c in ("train_loss", "val_loss")]
    )


# --- document operators ------------------------------------------------------


@query
def similar_docs_topk(spark, sf):
    return _similar(spark, sf)


def _hashed(spark, sf):
    vectors = _embeddings(spark, sf)
    return approximate.search(vectors, approximate.build_index(vectors), 5)


@query
def similar_docs_hashed(spark, sf):
    """Neighbours by the hash index; ``similar_docs_recall`` says how many it finds."""
    return _hashed(spark, sf)


@query
def similar_docs_recall(spark, sf):
    """The exact neighbours, and whether the hash index finds nine of ten; no cosine of it may differ."""
    found = approximate.recall(cut(_similar(spark, sf)), cut(_hashed(spark, sf)))
    return found.select(
        F.col("n").alias("n_neighbours"), (F.col("recall") >= 0.9).alias("recall_reached"), "n_wrong"
    )


@query
def doc_embedding(spark, sf):
    vectors = summary.doc_embedding(_documents(spark, sf), "doc_id", _tokens())
    return vectors.select("doc_id", F.posexplode("embedding").alias("dim", "v")).select(
        "doc_id", F.col("dim").cast("bigint").alias("dim"), F.round("v", 6).alias("v")
    )


@query
def extractive_summary(spark, sf):
    return summary.extractive_summary(_documents(spark, sf), "doc_id", "text", 2)


# --- streaming ---------------------------------------------------------------


@query
def stream_ingest(spark, sf):
    """Two overlapping drops through one checkpoint: every page is stored once."""
    drops, store, progress = (scratch(spark, n) for n in ("drops", "store", "progress"))
    pages = _pages(spark, sf)
    for drop in (pages.where(_hub().isin("en", "fr")), pages):
        drop.write.mode("append").parquet(drops)
        jobs.ingest(jobs.file_stream(spark, drops), store, progress, _hub(), SITE).awaitTermination()
    return spark.read.parquet(store).select("category", "url", "title")


@query
def stream_clean(spark, sf):
    out, progress = scratch(spark, "cleaned"), scratch(spark, "progress")
    pages = jobs.file_stream(spark, f"{sf}/pages.parquet")
    rows = jobs.clean_stream(pages, _hub(), SITE, **_clean_rules())
    jobs.append_to(rows, out, progress).awaitTermination()
    return _flat(spark.read.schema(rows.schema).parquet(out))


@query
def stream_score(spark, sf):
    out, progress = scratch(spark, "scored"), scratch(spark, "progress")
    model = training.train(_documents(spark, sf), TOPIC)
    ids = ["conv_id", "turn"]
    talks = jobs.file_stream(spark, f"{sf}/conversations.parquet", _talks(spark, sf).schema)
    jobs.score_stream(talks, ids, model, out, progress).awaitTermination()
    return _response(spark.read.parquet(out), ids, model.classes)
