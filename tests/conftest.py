import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float) and v != v:
        return None
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


@pytest.fixture(scope="session")
def same(spark, duck, sf):
    """Compares a query with its SQL, rows in any order."""

    def compare(query, sql):
        df = query(spark, sf)
        columns = sorted(df.columns)
        got = sorted((tuple(_plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
        assert got == want

    return compare
