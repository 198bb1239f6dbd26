import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from packetsieve.catalog import ORACLES, QUERIES
from packetsieve.catalog import queries as catalog_queries
from tools.check_queries import difference

TABLES = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    got = QUERIES[name](spark, TABLES).toPandas()
    assert len(got) > 0
    assert difference(got, database.execute(ORACLES[name]).df()) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_settled_fit_goes_on_after_the_rounds_of_the_sql(spark, monkeypatch):
    monkeypatch.setattr(catalog_queries, "FIT_ROUNDS", 1)
    costs = [{r["restart"]: r["cost"] for r in queries()[q](spark, TABLES).collect()} for q in ("kmeans_fit", "kmeans_fit_settled")]
    assert costs[0].keys() == costs[1].keys()
    assert all(costs[1][i] <= costs[0][i] for i in costs[0]) and costs[1] != costs[0]


def test_entry(spark):
    assert entry(spark).count() == 1
