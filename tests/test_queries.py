"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoloom.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return repr(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    found = db.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", ["gallery_vectors", "gallery_kept_parquet", "gallery_kept_json", "index_kept", "znorm_series", "class_centroids"])
def test_small_negative_numbers_keep_their_sign(spark, db, tmp_path, name):
    """To the sign of a zero: what rounds to zero, halves and ties of binary numbers."""
    values = [-1e-7, 1e-7, -4.9e-7, 5e-7, -5e-7, 0.0, -0.0, 1.0000005, -2.5e-6, 3.0, 0.1234565, -0.3, 1e-6, 2.0**-7, -(2.0**-7), 0.5]
    rows = [(i, [values[(i * 5 + k * (1 + i % 3)) % 16] for k in range(64)], i % 2) for i in range(12)]
    # a series with mean 0 and deviation 1 about 0
    points = [(i, "2024-01-01 00:00:00", u, "view", v) for u, s in enumerate([[-1.0, 1.0, -1e-7], [2.0, -2.0, 4e-7, 0.0], [1.0, 2.0, 4.5]]) for i, v in enumerate(s)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(points, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(f"{tmp_path}/events.parquet")
    own = duckdb.connect()
    for t in ("embeddings", "events"):
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df, found = QUERIES[name](spark, str(tmp_path)), own.execute(SQL[name])
    at = [df.columns.index(d[0]) for d in found.description]
    want = sorted(map(repr, map(tuple, found.fetchall())))
    assert sorted(repr(tuple(r[i] for i in at)) for r in df.collect()) == want and "-0.0" in "".join(want)


def test_entry_without_the_text_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def gone(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("gone", name=name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", gone)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)
