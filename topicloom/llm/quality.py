"""Quality rules with host verdicts, from DataFrame functions only.

Every document is measured where it lies. Rule failures are summed by host
(map-side first, so a host with a third of all rows costs one row per task),
the hosts' failure rates are shrunk towards a beta prior fitted to all hosts,
and documents of hosts whose shrunk rate is surely too high are rejected together
with the documents that fail the base rules themselves.

Defined results: a NULL or empty text has no words and fails the base rules;
rows with a NULL host form one host of their own; repeated rows are judged
each; an empty table gives an empty table; other columns are untouched,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import fresh, ref
from topicloom.llm.words import WORD
from topicloom.runtime import small_side

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules, of the rules counted per host, and of the host verdict."""

    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbol_pct: int = 25
    max_dup_line_pct: int = 30
    max_host_rate: float = 0.5


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure_quality(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with a struct column ``name`` of the measures, all ``long``.

    A window of eight words is known by a 64-bit hash of its words' hashes,
    compared only with the windows of the same text.
    """
    def step(name_: str) -> str:
        return fresh(docs, name_)

    words, keys, hashes, order, lines = map(step, ("_words", "_keys", "_hashes", "_order", "_lines"))
    whole = F.coalesce(ref(text), F.lit(""))
    n, k, h, s = F.size(words), F.col(keys), F.col(hashes), F.col(order)
    df = docs.withColumns(
        {
            words: F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)),
            lines: F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD)),
        }
    )
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn(
        keys,
        F.when(
            n >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), n - WINDOW),
                lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]),
            ),
        ),
    )
    # Only a text with a repeated window is looked at more closely.
    df = df.withColumn(
        order,
        F.when(
            F.size(F.array_distinct(k)) < F.size(k),
            F.sort_array(F.transform(k, lambda key, i: F.struct(key.alias("k"), i.alias("i")))),
        ),
    )

    def repeated(row: Column, j: Column) -> Column:
        before = F.get(s, j - 1)["k"].eqNullSafe(row["k"])
        return before | F.get(s, j + 1)["k"].eqNullSafe(row["k"])

    places = F.sort_array(F.transform(F.filter(s, repeated), lambda row: row["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        places,
        start,
        lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("n"),
            (p + WINDOW).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    measures = (
        n,
        F.char_length(F.array_join(words, "")),
        F.regexp_count(whole, F.lit(SYMBOLS)),
        F.size(lines),
        F.size(lines) - F.size(F.array_distinct(lines)),
        F.coalesce(covered, F.lit(0)),
    )
    made = F.struct(*[m.cast("long").alias(as_) for m, as_ in zip(measures, MEASURES, strict=True)])
    return df.withColumn(name, made).drop(words, keys, hashes, order, lines)


def base_failed(m: Column, rules: Rules) -> Column:
    return (m["n_words"] < rules.min_words) | (
        100 * m["n_repeat_words"] > rules.max_repeat_pct * m["n_words"]
    )


def rule_failed(m: Column, rules: Rules) -> Column:
    """What counts against a host: a base rule, too many symbols, too many repeated lines."""
    return (
        base_failed(m, rules)
        | (100 * m["n_symbols"] > rules.max_symbol_pct * m["word_chars"])
        | (100 * m["n_dup_lines"] > rules.max_dup_line_pct * m["n_lines"])
    )


def beta_prior(hosts: DataFrame, n: str, failed: str) -> tuple[float, float]:
    """The beta distribution whose mean and variance the hosts' rates have.

    The variance that counting itself causes is taken off; hosts that differ no
    more than that share one rate, which a prior of 10**6 rows stands for.
    """
    rate = F.col(failed) / F.col(n)
    got = hosts.agg(
        F.sum(failed).alias("f"), F.sum(n).alias("n"), F.var_samp(rate).alias("v"), F.avg(1 / F.col(n)).alias("e")
    ).first()
    if not got["n"]:
        return 1.0, 1.0
    mean = min(max(got["f"] / got["n"], 1e-6), 1 - 1e-6)
    spread = mean * (1 - mean)
    between = (got["v"] or 0.0) - spread * got["e"]
    size = min(max(spread / between - 1, 1.0), 1e6) if between > 0 else 1e6
    return mean * size, (1 - mean) * size


def host_verdicts(measured: DataFrame, host: str, measures: str, rules: Rules) -> DataFrame:
    """Hosts to reject, as ``_host``: hosts whose shrunk failure rate is surely above the limit.

    Surely: by two standard deviations, so a few bad documents do not condemn a small host.
    """
    hosts = measured.groupBy(_host(host)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(rule_failed(ref(measures), rules)).alias("failed"),
    )
    a, b = beta_prior(hosts, "n", "failed")
    size = F.col("n") + F.lit(a + b)
    rate = (F.col("failed") + F.lit(a)) / size
    sure = rate - 2 * F.sqrt(rate * (1 - rate) / (size + 1))
    return hosts.where(sure > rules.max_host_rate).select("_host")


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), ref(host).cast("string")), F.lit("")).alias("_host")


def judge(
    measured: DataFrame, host: str, measures: str, kept: str, rules: Rules = Rules()
) -> DataFrame:
    """``measured`` (a written table, it is read twice) with the boolean column ``kept``."""
    bad, _ = small_side(host_verdicts(measured, host, measures, rules))
    key, hit = fresh(measured, "_host_key"), fresh(measured, "_host_hit")
    bad = bad.select(F.col("_host").alias(key), F.lit(True).alias(hit))
    rows = measured.withColumn(key, _host(host)).join(bad, key, "left")
    return rows.withColumn(
        kept, ~base_failed(ref(measures), rules) & F.col(hit).isNull()
    ).drop(key, hit)
