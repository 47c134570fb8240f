from pyspark.sql import functions as F

from pagemill.llm.bloom import BROADCAST_BYTES
from pagemill.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, kept string, block_ int"


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.block_) for r in exact_dedup(df, **more).collect()), key=repr)


def test_groups_nulls_ties_and_clashing_names(spark):
    rows = [(1, "a", "x", 7), (5, "a", "x", 8), (3, "a", None, 9), (2, None, "y", 1), (4, "", "y", 2), (None, "b", "z", 3), (None, "b", "z", 4), (8, "long " * 200_000, "q", 5), (9, "a ", "q", 6)]
    want = [(1, 5, 3, False, 7), (5, 5, 3, True, 8), (3, 5, 3, False, 9), (2, 4, 2, False, 1), (4, 4, 2, True, 2), (8, 8, 1, True, 5), (9, 9, 1, True, 6)]
    for limit in (1 << 20, 0):  # the filter at 16 bits a row, and none that tells
        got = run(spark, rows, broadcast_bytes=limit)
        assert [x for x in got if x[0] is not None] == sorted(want, key=repr)
        assert sorted(x[3] for x in got if x[0] is None) == [False, True]


def test_repeated_rows_leave_one(spark):
    got = run(spark, [(7, "same", "k", 1)] * 50)
    assert [x[:3] for x in got] == [(7, 7, 50)] * 50 and sum(x[3] for x in got) == 1


def test_empty(spark):
    df = exact_dedup(spark.createDataFrame([], SCHEMA))
    assert df.collect() == [] and df.columns[:3] == ["doc_id", "text", "block_"]


def shuffled_bytes(spark):
    """Bytes that all stages of the session have written to shuffles so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_unique_texts_are_not_shuffled_at_any_size(spark):
    # 20 000 texts of random 3 KB, a tenth of them twice: 66 MB that doesn't compress
    n = 20_000
    text = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(48)), lambda k: F.sha2(F.concat_ws("-", "id", k.cast("string")), 256)))
    one = spark.range(n).withColumn("text", text)
    docs = one.unionByName(one.where("id % 10 = 0").withColumn("id", F.col("id") + n)).withColumnRenamed("id", "doc_id")
    for limit in (BROADCAST_BYTES, 8192, 4096):  # 16 bits a row; 3 bits a row; too few, so that digests are counted first
        before = shuffled_bytes(spark)
        rows = {r.doc_id: r for r in exact_dedup(docs, broadcast_bytes=limit).select("doc_id", "keep_id", "group_size", "kept", F.length("text").alias("size")).collect()}
        assert all((r.keep_id, r.group_size, r.kept) == ((n + r.doc_id % n, 2, r.doc_id >= n) if r.doc_id % 10 == 0 else (r.doc_id, 1, True)) for r in rows.values())
        assert len(rows) == 22_000 and all(r.size == 3072 for r in rows.values())
        assert shuffled_bytes(spark) - before < (18_000_000 if limit > 4096 else 22_000_000)  # the texts alone are 67 MB, 12 MB of them twice


def test_a_heavy_group_stays_where_it_is(spark, monkeypatch):
    from pagemill.llm import tables

    monkeypatch.setattr(tables, "MOST_HEAVY", 4)
    rows = [(k, "very often", None, 0) for k in range(40)] + [(100 + k, f"twice {k // 2}", None, 0) for k in range(40)]
    got = run(spark, rows)
    assert [x[:3] for x in got if x[0] < 100] == [(k, 39, 40) for k in sorted(range(40), key=lambda k: repr((k,)))]
    assert {x[2] for x in got if x[0] >= 100} == {2} and sum(x[3] for x in got) == 21


def test_only_possible_repeats_are_shuffled(spark):
    from pagemill.llm import exact_dedup as module

    seen = []
    original, module.kept = module.kept, lambda df, *a: seen.append(original(df, *a)) or seen[-1]
    try:
        rows = [(k, f"text {k}", None, 0) for k in range(2000)] + [(5000 + k, "twice", None, 0) for k in range(30)]
        assert sum(r.kept for r in exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()) == 2001
    finally:
        module.kept = original
    assert 30 <= seen[0].count() <= 30 + 2000 * 0.05
