"""The numbered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.llm import (
    bpe,
    chat,
    fim,
    jaccard,
    lines,
    mixing,
    pages,
    periodic,
    quality,
    simhash,
    substrings,
    topk,
    toxicity,
)
from topicloom.llm.common import numbered, table, vocabulary
from topicloom.llm.words import WORD, count_words
from topicloom.runtime import cut, small_side

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(make):
        QUERIES[name] = make
        if sql:
            SQL[name] = sql
        return make

    return add


@query(
    "op1_mix_sources",
    """
    WITH d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
      FROM documents
    ), s AS (
      SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS no
      FROM d GROUP BY source
    ), w AS (
      SELECT *, 2 * source_size AS cap, [5, 2, 1][no % 3 + 1] AS w, sum(source_size) OVER () AS everything FROM s
    ), f AS (
      SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
      FROM w
    ), l AS (
      SELECT *, 3 * everything - 2 * filled AS rest, 2 * open_w AS under,
             (3 * everything - 2 * filled) * w >= cap * 2 * open_w AS is_full FROM f
    ), o AS (
      SELECT *, min({'r': cap / w, 'no': no, 'rest': rest, 'under': under}) FILTER (NOT is_full) OVER () AS lvl FROM l
    ), t AS (
      SELECT source, source_size,
             CASE WHEN is_full OR lvl IS NULL THEN cap::DOUBLE
                  ELSE (lvl.rest * w)::DOUBLE / lvl.under::DOUBLE END AS target
      FROM o
    ), p AS (
      SELECT d.doc_id, d.size, t.source_size, t.target,
             sum(d.size) OVER (PARTITION BY d.source
               ORDER BY ('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT, d.doc_id, d.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before,
             CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size::BIGINT AS size, source_size, target,
           (epochs * size + least(greatest(floor(target)::BIGINT - epochs * source_size - before, 0), size))::BIGINT AS taken
    FROM p
    """,
)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")))
    return mixing.mix(sized, "doc_id", "source", "size").drop("source")


@query(
    "op2_ngram_jaccard",
    """
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
      FROM documents
    ), s AS (
      SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) AS g
      FROM d WHERE len(w) > 0
    ), k AS (
      SELECT min(doc_id) AS rep, list(doc_id) AS ids, list_sort(g) AS g FROM s GROUP BY list_sort(g)
    ), t AS (SELECT rep, len(g) AS n, unnest(g) AS t FROM k
    ), p AS (
      SELECT x.rep AS x, y.rep AS y FROM t x JOIN t y ON x.t = y.t AND x.rep < y.rep
      WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
      GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
    ), e AS (SELECT x AS a, y AS b FROM p UNION SELECT y, x FROM p
    ), r AS (
      SELECT rep AS node, rep AS seen FROM k
      UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen
    ), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
    SELECT d.doc_id, coalesce(len(s.g), 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
    FROM d LEFT JOIN s ON s.doc_id = d.doc_id
    LEFT JOIN (SELECT rep, unnest(ids) AS doc_id FROM k) m ON m.doc_id = d.doc_id
    LEFT JOIN c ON c.node = m.rep
    """,
)
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"), "row")
    groups = jaccard.similar_groups(docs, "row", "doc_id", "text", n=3, num=90, den=100)
    return groups.select("doc_id", "n_shingles", "component_id")


@query(
    "op3_chat_format",
    """
    WITH m AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')
    ), o AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS i FROM m
    ), e AS (
      SELECT *, replace(replace(replace(text, '\\', '\\b'), '###', '\\h'), '</turn>', '\\e') AS body,
             replace(replace(replace(replace(role, '\\', '\\b'), '###', '\\h'), '</turn>', '\\e'), ':', '\\c') AS head FROM o
    )
    SELECT conv_id, count(*)::BIGINT AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length('### ' || head || ': ' || body || '</turn>' || chr(10)))::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(
        spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    )
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = cut(
        rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
        .withColumn("msg", F.row_number().over(place))
        .withColumns({"parent": F.when(F.col("msg") > 1, F.col("msg") - 1), "score": F.lit(0.0)})
    )
    paths = chat.format_paths(rows, "conv_id", "msg", "parent", "score", "role", "text")
    read = paths.withColumns(
        {
            "turns": chat.read_turns(F.col("formatted")),
            "learned": F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), ""),
        }
    )
    lines_ = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines_, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op4_bpe_encode")
def op4_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = bpe.Tokenizer.fit(docs, "text", vocabulary())
    coded = tokenizer.encode(docs, "text", "ids").select("doc_id", "ids")
    return tokenizer.decode(coded, "ids", "decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op5_line_dedup",
    """
    WITH l AS (
      SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS place,
             unnest(string_split(text, chr(10))) AS line
      FROM documents
    ), u AS (
      SELECT line, length(line) AS n, min({'d': doc_id, 'p': place}) AS first
      FROM l WHERE length(line) >= 40 GROUP BY line
    ), pairs AS (
      SELECT x.line AS a, y.line AS b FROM u x JOIN u y
      ON left(x.line, (x.n // 2)::INT) = left(y.line, (x.n // 2)::INT) AND y.n - x.n IN (0, 1) AND x.line <> y.line
      UNION
      SELECT x.line, y.line FROM u x JOIN u y
      ON right(x.line, (x.n - x.n // 2)::INT) = right(y.line, (x.n - x.n // 2)::INT) AND y.n - x.n IN (0, 1) AND x.line <> y.line
    ), links AS (
      SELECT a, b FROM pairs WHERE levenshtein(a, b) <= 1
      UNION SELECT b, a FROM pairs WHERE levenshtein(a, b) <= 1
    ), near AS (
      SELECT DISTINCT x.line FROM links JOIN u x ON x.line = a JOIN u y ON y.line = b WHERE y.first < x.first
    ), judged AS (
      SELECT l.*, u.line IS NOT NULL
             AND (u.first <> {'d': l.doc_id, 'p': l.place} OR near.line IS NOT NULL) AS gone
      FROM l LEFT JOIN u ON u.line = l.line LEFT JOIN near ON near.line = l.line
    )
    SELECT d.doc_id, count(j.line)::BIGINT AS n_lines, count(*) FILTER (j.gone)::BIGINT AS n_removed,
           sha256(coalesce(string_agg(j.line, chr(10) ORDER BY j.place) FILTER (NOT j.gone), '')) AS kept_sha256
    FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id
    """,
)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.coalesce(F.col("kept"), F.array().cast("array<string>"))
    n = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(n).cast("long")
    return lines.dedup_lines(docs, "doc_id", "text", "kept").select(
        "doc_id",
        n.alias("n_lines"),
        (n - F.size(kept)).cast("long").alias("n_removed"),
        F.sha2(F.array_join(kept, "\n"), 256).alias("kept_sha256"),
    )


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    seen = labels.where(~toxicity.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen, _ = small_side(cut(seen))
    model = toxicity.train(docs.join(seen, "doc_id"), "text", "toxic")
    return toxicity.score(docs, "text", model, "score").select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query(
    "op7_quality_rules",
    """
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM documents
    ), w AS (
      SELECT r, i, list_slice(words, i, i + 7) AS win
      FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)
    ), again AS (
      SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM w) WHERE n > 1
    ), covered AS (
      SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM again) GROUP BY r
    ), m AS (
      SELECT d.r, doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM d LEFT JOIN covered c USING (r)
    ), b AS (
      SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
    ), f AS (
      SELECT *, base_failed OR 100 * n_symbols > 25 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS failed FROM b
    ), h AS (
      SELECT source, count(*) AS n, count(*) FILTER (failed) AS k FROM f GROUP BY source
    ), p AS (
      SELECT least(greatest(sum(k) / sum(n), 1e-6), 1 - 1e-6) AS mean, var_samp(k / n) AS v, avg(1 / n) AS e FROM h
    ), q AS (
      SELECT mean, CASE WHEN coalesce(v, 0) - mean * (1 - mean) * e > 0
             THEN least(greatest(mean * (1 - mean) / (v - mean * (1 - mean) * e) - 1, 1.0), 1e6) ELSE 1e6 END AS size
      FROM p
    ), bad AS (
      SELECT source FROM (SELECT source, (k + mean * size) / (n + size) AS rate, n + size AS all_ FROM h, q)
      WHERE rate - 2 * sqrt(rate * (1 - rate) / (all_ + 1)) > 0.5
    )
    SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept
    FROM f
    """,
)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = cut(quality.measure_quality(docs, "text", "m").drop("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judge(measured, "source", "m", "kept").select(
        "doc_id",
        *[F.col(f"m.{n}").alias(n) for n in names],
        quality.base_failed(F.col("m"), quality.Rules()).alias("base_failed"),
        "kept",
    )


@query(
    "op8_exact_topk",
    """
    WITH v AS (
      SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.r, q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
      FROM v q JOIN v ON v.r <> q.r WHERE q.vec_id % 20 = 0
    )
    SELECT query_id, rank::INT AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
    """,
)
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, "vec_id", "embedding", F.col("id") % 20 == 0, 20)


@query(
    "op9_substring_dedup",
    """
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
      FROM documents
    ), v AS (
      SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS win
      FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
    ), again AS (
      SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY win) AS n FROM v) WHERE n > 1
    ), gone AS (
      SELECT r, list(DISTINCT j) AS js FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM again) GROUP BY r
    ), x AS (
      SELECT d.r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d
    ), kept AS (
      SELECT x.r, string_agg(word, ' ' ORDER BY j) AS t FROM x LEFT JOIN gone ON gone.r = x.r
      WHERE gone.r IS NULL OR NOT list_contains(gone.js, x.j) GROUP BY x.r
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
           sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN gone ON gone.r = d.r LEFT JOIN kept ON kept.r = d.r
    """,
)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"), "row")
    size = F.aggregate("removed", F.lit(0), lambda n, s: n + s["hi"] - s["lo"])
    return substrings.remove_repeats(docs, "row", "text").select(
        "doc_id", "n_words", size.cast("long").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op10_main_text")
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.extract_main_text(rows, "html", "text").select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


@query(
    "op11_fill_in_middle",
    """
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
             sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex
      FROM documents
    ), h AS (
      SELECT *, ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2,
             ('0x' || substr(hex, 17, 8))::BIGINT AS h3, ('0x' || substr(hex, 25, 8))::BIGINT AS h4
      FROM d
    ), c AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                       OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
      FROM h
    ), p AS (
      SELECT *, substr(text, 1, lo) AS prefix, substr(text, lo + 1, hi - lo) AS middle,
             substr(text, hi + 1, n - hi) AS suffix
      FROM c
    )
    SELECT doc_id, n::BIGINT AS n, form,
           CASE WHEN form <> 'plain' THEN lo END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text
                  WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p
    """,
)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fim.fill_in_middle(docs, "doc_id", "text", "fim").drop("text")
    return made.select(
        "doc_id",
        *[F.col(f"fim.{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")],
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


@query("op12_simhash_near_dedup")
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_groups(docs, "doc_id", "text").select("doc_id", "fingerprint", "component_id")


def _with_periodic_tails(docs: DataFrame) -> DataFrame:
    """The input of op13: every tenth document's words repeat from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, 1, a), F.slice(tail, 1, n - a)), " ")

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    # In a lambda of its own, so that the words are found once a text.
    made = F.transform(F.array(words), repeated)[0]
    planted = (h % 10 == 0) & F.col("text").rlike(WORD)
    return docs.withColumn("text", F.when(planted, made).otherwise(F.col("text")))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.periodic_runs(docs, "text", "found")
    one = F.transform("found.runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("found.runs").cast("long").alias("n_runs"),
        *[F.col(f"found.best.{c}").alias(c) for c in periodic.NAMES],
        F.expr("1000 * found.best.length div found.best.period").alias("exponent_milli"),
        F.sha2(F.array_join(one, ""), 256).alias("runs_sha256"),
        F.sha2("found.collapsed", 256).alias("collapsed_sha256"),
    )
