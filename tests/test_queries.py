"""Every query against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from curatrix.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_entry_gives_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "sha256" in df.columns


def test_embedding_scores_separate(spark):
    scores = registry.QUERIES["embedding_scores"](spark, SF)
    labels = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label")
    rows = scores.join(labels, "vec_id").collect()
    mean = lambda hit: sum(r["score"] for r in rows if (r["label"] == 0) == hit) / max(1, sum((r["label"] == 0) == hit for r in rows))
    assert len(rows) == labels.count() and mean(True) > mean(False)
