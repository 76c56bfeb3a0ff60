"""Training, applying and comparing topic classifiers."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.core.broadcast import Broadcast
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.arrays import argmax, softmax
from topicloom.functions.text import normalize, preview, tokenize
from topicloom.operators.joins import frequent_rows, rest_values
from topicloom.operators.lookup import add_weights, send, sum_weights
from topicloom.operators.metrics import evaluation
from topicloom.runtime import BROADCAST_BYTES, cut, measure

HASH_FEATURES = 1 << 18


@dataclass
class TokenBayes:
    """Multinomial naive Bayes kept as a table.

    ``weights`` has one row per token: its log-likelihood in every class, in
    the order of ``classes``. Only the class list and its priors are on the
    driver; the vocabulary never is.
    """

    classes: list
    priors: list[float]
    weights: DataFrame
    _held: Broadcast | None = field(default=None, repr=False, compare=False)

    def save(self, path: str) -> None:
        """Write the model as two Parquet tables."""
        spark = self.weights.sparkSession
        rows = [(i, str(c), p) for i, (c, p) in enumerate(zip(self.classes, self.priors))]
        head = spark.createDataFrame(rows, "idx int, label string, prior double")
        head.coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TokenBayes:
        """Read a saved model; class labels come back as strings."""
        head = spark.read.parquet(f"{path}/classes").orderBy("idx").collect()
        weights = spark.read.parquet(f"{path}/weights")
        return cls([r["label"] for r in head], [r["prior"] for r in head], weights)

    def class_id(self, label: Column) -> Column:
        """Index of a class label, NULL for one the model does not know."""
        names = F.array(*[F.lit(str(c)) for c in self.classes])
        return F.nullif(F.array_position(names, label.cast("string")), F.lit(0)) - 1

    def class_name(self, idx: Column) -> Column:
        """Label of a class index."""
        return F.get(F.array(*[F.lit(str(c)) for c in self.classes]), idx)

    def fits(self, limit: int = BROADCAST_BYTES) -> bool:
        """Whether the weights are small enough to be sent to every task."""
        return measure(self.weights)[1] <= limit

    def release(self) -> None:
        """Take the weights back from the tasks; the next use measures and sends them again."""
        if self._held is not None:
            self._held.unpersist()
            self._held = None

    def logits(
        self, docs: DataFrame, ids: list[str], tokens: Column, limit: int = BROADCAST_BYTES
    ) -> DataFrame:
        """``(ids, logits)``: log prior plus the summed token weights.

        Unknown tokens add nothing. Weights that fit are sent to the tasks and
        every text is scored where it lies, once for all uses of the model; of
        larger ones those of the most frequent tokens are sent, and only what else
        a text holds is joined. Either way a repeated or missing id is a row like
        any other.
        """
        if self._held is None and self.fits(limit):
            self._held = send(self.weights, "token", "w")
        if self._held is not None and limit:
            return sum_weights(docs, ids, tokens, self._held, self.priors, "logits")
        # The likelier a token is in some class, the more often it occurs.
        top = F.array_max("w")
        low = self.weights.agg(F.min(top)).first()[0] or 0.0
        head = frequent_rows(self.weights.select("token", "w"), F.exp(top - F.lit(low)), limit=limit)
        keyed = docs.select(*ids, tokens.alias("_tokens"), F.monotonically_increasing_id().alias("_row"))
        sent = send(head, "token", "w")
        sums = cut(sum_weights(keyed, ["_row", *ids], F.col("_tokens"), sent, self.priors, "logits", rest=True))
        found = rest_values(sums, self.weights, "w", limit=limit)
        return add_weights(found, ids, "logits", len(self.classes))


def fit_token_bayes(
    docs: DataFrame, label: str, tokens: Column, smoothing: float = 1.0
) -> TokenBayes:
    """Count tokens per class once; the model is that table of logarithms."""
    rows = docs.where(F.col(label).isNotNull())
    stats = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()
    classes = [r[label] for r in stats]
    schema = T.StructType([rows.schema[label], T.StructField("_class", T.IntegerType())])
    places = docs.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], schema)
    every, zero = F.array(*[F.lit(i) for i in range(len(classes))]), F.lit(0).cast("bigint")
    # The token expression goes straight into explode. As a column of its own
    # it would also be evaluated in a filter Spark infers for its size.
    counts = cut(
        rows.select(label, F.explode(tokens).alias("token"))
        .groupBy("token", label)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(places), label)  # one row per class, which the driver holds anyway
        .groupBy("token")
        .agg(F.map_from_entries(F.collect_list(F.struct("_class", "n"))).alias("m"))
        .select("token", F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i), zero)).alias("n"))
    )
    sums = counts.select(F.posexplode("n").alias("c", "n")).groupBy("c")
    found = {r["c"]: r for r in sums.agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n")).collect()}
    size = found[0]["size"] if found else 0
    totals = [found[i]["n"] if found else 0 for i in range(len(classes))]
    n_docs = sum(r["n"] for r in stats)
    priors = [
        math.log(r["n"] + smoothing) - math.log(n_docs + smoothing * len(classes)) for r in stats
    ]
    base = [math.log(t + smoothing * size) if size else 0.0 for t in totals]
    weights = counts.select(
        "token",
        F.zip_with(
            "n", F.array(*map(F.lit, base)), lambda n, b: F.ln(n + F.lit(smoothing)) - b
        ).alias("w"),
    )
    return TokenBayes(classes, priors, weights)


def respond(
    df: DataFrame, text: Column, normal: Column, logits: Column, keep: list[str]
) -> DataFrame:
    """The response of the classifier for every row, errors as data.

    ``normal`` is the normalised text. Missing or empty texts get an error
    message, class -1 and empty arrays.
    """
    error = F.when(text.isNull(), F.lit("text is missing")).when(
        normal == "", F.lit("text has no tokens")
    )
    none = F.array().cast("array<double>")
    base = df.select(
        *keep,
        F.coalesce(preview(text), F.lit("")).alias("text"),
        F.coalesce(normal, F.lit("")).alias("preprocessed_text"),
        F.when(error.isNull(), logits).otherwise(none).alias("logits"),
        error.alias("error"),
    )
    return base.select(
        *keep,
        "text",
        "preprocessed_text",
        argmax(F.col("logits")).alias("predicted_class"),
        softmax(F.col("logits")).alias("class_probabilities"),
        "logits",
        "error",
    )


def score_documents(
    docs: DataFrame,
    ids: list[str],
    model: TokenBayes,
    text: str = "text",
    keep: tuple = (),
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Score every text: preview, class, probabilities, logits or an error.

    With a model the tasks can hold, nothing is shuffled.
    """
    rows = docs.select(*ids, *keep, text)
    tokens = tokenize(F.col(text))
    scored = model.logits(rows, rows.columns, tokens, limit).withColumn("_normal", normalize(F.col(text)))
    return respond(scored, F.col(text), F.col("_normal"), F.col("logits"), [*ids, *keep])


# --- pyspark.ml classifiers --------------------------------------------------

_STAGES = {
    "logistic": lambda p: LogisticRegression(
        featuresCol="features", labelCol="target",
        maxIter=p.get("num_epochs", 10), regParam=p.get("reg", 1e-4),
    ),
    "naive_bayes": lambda p: NaiveBayes(
        featuresCol="features", labelCol="target", smoothing=p.get("smoothing", 1.0)
    ),
}


def model_kinds() -> list[str]:
    """Names ``train_topic_model`` takes."""
    return sorted(_STAGES)


def train_topic_model(df: DataFrame, kind: str, label: str, params: dict | None = None) -> PipelineModel:
    """Fit ``kind`` on rows with ``tokens`` and ``label``.

    Tokens are hashed into a fixed number of features, so neither vocabulary
    nor model grows with the corpus.
    """
    params = params or {}
    _known(kind)
    return Pipeline(stages=[*_feature_stages(label, params), _STAGES[kind](params)]).fit(df)


def _known(kind: str) -> None:
    if kind not in _STAGES:
        raise ValueError(f"unknown model {kind!r}, expected one of {model_kinds()}")


def _feature_stages(label: str, params: dict) -> list:
    return [
        StringIndexer(
            inputCol=label, outputCol="target", handleInvalid="skip",
            stringOrderType="alphabetAsc",
        ),
        HashingTF(
            inputCol="tokens", outputCol="tf",
            numFeatures=params.get("features", HASH_FEATURES),
        ),
        IDF(inputCol="tf", outputCol="features"),
    ]


def apply_topic_model(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``logits`` and ``pred`` of a fitted model."""
    logits = vector_to_array(F.col("rawPrediction"))
    return (
        model.transform(df)
        .withColumn("logits", logits)
        .withColumn("pred", argmax(F.col("logits")).cast("int"))
        .drop("tf", "features", "rawPrediction", "probability", "prediction")
    )


def choose_model(
    train: DataFrame, val: DataFrame, label: str, kinds: list[str], params: dict | None = None
) -> DataFrame:
    """Accuracy, macro F1 and loss on ``val`` of every kind, best F1 first.

    Tokens are made once for both sides and features once for all kinds, which
    every fit passes over several times.
    """
    params = params or {}
    for kind in kinds:
        _known(kind)
    train, val = (cut(df.select(label, "tokens")) for df in (train, val))
    features = Pipeline(stages=_feature_stages(label, params)).fit(train)
    train, val = (cut(features.transform(df).select("target", "features")) for df in (train, val))
    results = None
    for kind in kinds:
        scored = apply_topic_model(PipelineModel([_STAGES[kind](params).fit(train)]), val)
        row = evaluation(
            scored.withColumn("target", F.col("target").cast("int")), "target", "pred", "logits"
        ).select(F.lit(kind).alias("kind"), "accuracy", "macro_f1", "loss", "n")
        results = row if results is None else results.unionByName(row)
    return results.orderBy(F.col("macro_f1").desc(), "kind")


def multilabel_baseline(
    train: DataFrame, test: DataFrame, ids: list[str], labels: list[str], params: dict | None = None
) -> DataFrame:
    """One binary logistic model per 0/1 label column: predicted (ids, label) pairs.

    Features are computed once and reused by all labels.
    """
    params = params or {}
    hashing = HashingTF(
        inputCol="tokens", outputCol="tf", numFeatures=params.get("features", HASH_FEATURES)
    )
    features = Pipeline(stages=[hashing, IDF(inputCol="tf", outputCol="features")]).fit(train)
    seen = cut(features.transform(train).select(*labels, "features"))
    unseen = cut(features.transform(test).select(*ids, "features"))
    out = None
    for name in labels:
        fitted = LogisticRegression(
            featuresCol="features", labelCol=name,
            maxIter=params.get("num_epochs", 10), regParam=params.get("reg", 1e-2),
        ).fit(seen)
        hit = (
            fitted.transform(unseen)
            .where(F.col("prediction") == 1.0)
            .select(*ids, F.lit(name).alias("label"))
        )
        out = hit if out is None else out.unionByName(hit)
    return out
