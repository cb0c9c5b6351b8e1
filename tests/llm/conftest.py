import duckdb
import pytest

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def engine(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


@pytest.fixture(scope="session")
def rows_of(engine):
    """The rows of a query over the small tables, as tuples."""
    return lambda sql: engine.execute(sql).fetchall()


@pytest.fixture
def frame(spark):
    """Rows as a frame of several partitions."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
