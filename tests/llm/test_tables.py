import os

from pyspark.sql import functions as F

from pagemill.llm.bloom import likely_in
from pagemill.llm.queries import QUERIES
from pagemill.llm.tables import join_groups
from pagemill.sources.folders import scratch, shared_folder


def test_nothing_is_left_after_a_run(spark, sf):
    folder = f"{shared_folder(spark).removeprefix('file://')}/tables"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scratch(spark):
        for name in ("op3_mix_sources", "op4_exact_dedup", "op6_unit_dedup"):
            assert QUERIES[name](spark, sf).count() > 0
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_a_folded_filter_misses_nothing(spark):
    """A filter may hold fewer bits for each member: no member is lost, and the share of others that passes is about what the docstring says."""
    rows, members = spark.range(200_000).withColumnRenamed("id", "k"), spark.range(0, 30_000).withColumnRenamed("id", "k")
    for limit, share in ((64 << 20, 0.014), (16_384, 0.15 * 1.2), (8192, 0.42 * 1.2)):
        likely, rest = likely_in(rows, ["k"], members, broadcast_bytes=limit)
        assert likely.where("k < 30000").count() == 30_000 and rest.count() + likely.count() == 200_000
        assert likely.where("k >= 30000").count() / 170_000 < share * 1.2


def test_groups_meet_their_rows_however_heavy(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), "id")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    got = join_groups(rows, groups, ["key"], "n", 5000)
    assert sorted(map(tuple, got.select("key", "id", "n", "most").collect())) == sorted(map(tuple, rows.join(groups, "key").select("key", "id", "n", "most").collect()))


def test_rows_without_an_id_meet_nothing(spark):
    from pagemill.llm.tables import join_by_id

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "c")], "i long, x string")
    found = spark.createDataFrame([(1, (5,)), (7, (6,))], "k long, r struct<n:int>")
    joined = join_by_id(rows, found, "i", "k", "r")
    assert sorted(((x.i, x.x, x.r and x.r.n) for x in joined.collect()), key=repr) == sorted([(1, "a", 5), (2, "b", None), (None, "c", None), (None, "c", None)], key=repr)
    assert joined.columns == ["i", "x", "r"]


def test_left_rows_of_groups(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), "id")
    groups = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 OR key % 2 = 0")
    got = join_groups(rows, groups, ["key"], "n", 5000, "left").select("key", "id", "n")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, rows.join(groups, "key", "left").select("key", "id", "n").collect()), key=repr)


def test_parts_of_batches():
    import pyarrow as pa

    from pagemill.llm.memory import in_parts, lean

    batches = [pa.record_batch({"x": list(range(n))}) for n in (0, 5, 2300)]
    assert [b.num_rows for b in in_parts(iter(batches))] == [5, 1000, 1000, 300]
    assert [b["x"].to_pylist() for b in lean(in_parts)(iter(batches))] == [b["x"].to_pylist() for b in in_parts(iter(batches))]
