"""Top-k over rows without ids and repeated rows."""

from pyspark.sql import functions as F

from topicloom.llm import topk
from topicloom.runtime import cut


def test_rows_without_an_id_are_found_last_of_ties(spark):
    rows = [(None, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (7, [0.5, 0.5]), (None, None), (3, [None, 1.0])]
    df = cut(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(df, "vec_id", "embedding", F.col("id") % 20 == 0, 4).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found[0] == [(1, 20, 4096), (2, 20, 4096), (3, None, 4096), (4, 7, 2048)]
    assert sorted(found[20], key=str) == sorted([(1, 0, 4096), (2, 20, 4096), (3, None, 4096), (4, 7, 2048)] * 2, key=str)
    none = topk.top_k(df.where("vec_id > 99"), "vec_id", "embedding", F.col("id") % 20 == 0, 4)
    assert none.count() == 0
