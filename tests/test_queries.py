import pytest

from pagemill.plans import flows  # noqa: F401  registers its queries
from pagemill.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_what_its_sql_gives(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_only_small_tables_in_few_files_are_dealt_anew(spark, tmp_path, monkeypatch):
    from pagemill.plans import tables

    for name, n in (("one", 1), ("many", 9)):
        spark.range(1000).repartition(n).write.parquet(str(tmp_path / name))
    one, many = (spark.read.parquet(str(tmp_path / name)) for name in ("one", "many"))
    cores = spark.sparkContext.defaultParallelism
    assert tables.spread(one).rdd.getNumPartitions() == cores and tables.spread(many) is many
    monkeypatch.setattr(tables, "PART_BYTES", 10)
    assert tables.spread(one) is one
