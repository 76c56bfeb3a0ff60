"""Names of the mixed table's own columns."""

import pytest
from pyspark.sql import functions as F

from topicloom.llm import mixing
from topicloom.runtime import cut


def test_columns_of_any_name_stay(spark):
    rows = [(i, f"s{i % 3}" if i % 4 else None, i % 5, "w " * (i % 5)) for i in range(40)]
    plain = cut(spark.createDataFrame(rows, "doc_id long, source string, size long, text string"))
    want = {(r.doc_id, r.target, r.taken) for r in mixing.mix(plain, "doc_id", "source", "size").collect()}
    extra = ["no", "_key", "_range", "_before", "n_rows", "n_ranges", "_source", "_first", "_sum", "_part", "in_0"]
    named = cut(plain.select("*", *[F.lit(c).alias(c) for c in extra]))
    out = mixing.mix(named, "doc_id", "source", "size")
    assert out.columns == [*named.columns, "source_size", "target", "taken"]
    got = out.collect()
    assert {(r.doc_id, r.target, r.taken) for r in got} == want
    assert all(r[c] == c for r in got for c in extra)
    copies = mixing.copies(out, "text", "size", "taken")
    assert copies.where("_part <> '_part'").count() == 0 and copies.columns == out.columns


def test_names_of_results_are_refused(spark):
    rows = spark.createDataFrame([(1, "a", 2, 0.5)], "doc_id long, source string, size long, Target double")
    with pytest.raises(ValueError):
        mixing.mix(rows, "doc_id", "source", "size")
