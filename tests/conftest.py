import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = f"{root}:{os.environ.get('PYTHONPATH', '')}"
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.sql(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value


@pytest.fixture(scope="session")
def same():
    """Compares a DataFrame's rows with those of a DuckDB relation, whatever the order of rows and columns."""

    def check(df, relation):
        names = sorted(df.columns)
        assert names == sorted(relation.columns)
        got = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)
        at = [relation.columns.index(n) for n in names]
        want = sorted((tuple(_plain(r[k]) for k in at) for r in relation.fetchall()), key=repr)
        assert got == want

    return check
