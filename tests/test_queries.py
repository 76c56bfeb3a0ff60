"""Every registered query against its SQL on the small tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of
from topicloom.operators import classify


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, db, sf, name):
    df = queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = db.execute(sql)
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, rel.fetchall())


def test_entry(spark):
    assert entry(spark).columns == ["doc_id", "n_tokens", "unk_rate", "seq"]


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name,operator", [("model_choice", "choose_model"), ("multilabel_baseline", "multilabel_baseline")])
def test_models_use_all_hashed_features(spark, sf, monkeypatch, name, operator):
    given = []

    def record(*args):
        given.append(args[-1])
        raise StopIteration

    monkeypatch.setattr(classify, operator, record)
    with pytest.raises(StopIteration):
        queries()[name](spark, sf)
    assert not isinstance(given[0], dict) or "features" not in given[0]
