"""Every registered query against the same computation in another SQL engine."""

import duckdb
import pytest

import __spark_entry__ as contract
from seriesmill.plans.catalog import QUERIES
from seriesmill.plans.oracles import ORACLES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def engine(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def comparable(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, "" if v is None else str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, engine, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    ours = comparable(tuple(r[c] for c in columns) for r in frame.collect())
    result = engine.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = comparable(tuple(r[i] for i in at) for r in result.fetchall())
    assert ours == theirs


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_one_row_per_asset(spark):
    frame = contract.entry(spark)
    rows = frame.collect()
    assert len(rows) == len({r["asset"] for r in rows}) == 5
