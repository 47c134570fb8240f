import numpy as np

from pagemill.llm.components import connected_components
from pagemill.llm.embedding_dedup import near_vectors, shape

SCHEMA = "vec_id long, embedding array<float>, label int, id string, kept string"


def brute(rows, threshold=0.98):
    good = {i: (label, np.array(v, np.float64)) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    links = {i: set() for i, *_ in rows}
    for i, (a, x) in good.items():
        for j, (b, y) in good.items():
            if i != j and a == b and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[i].add(j)
    low = {i: i for i in links}
    while (new := {i: min([low[i], *(low[j] for j in links[i])]) for i in links}) != low:
        low = new
    return {i: (len(links[i]), low[i], low[i] == i) for i in links}


def test_against_all_pairs(spark):
    r = np.random.default_rng(4)
    rows, base = [], r.normal(size=(60, 16))
    for k in range(300):
        rows.append((k, (base[k % 60] + r.normal(size=16) * r.choice([0.02, 0.15, 0.6])).astype(np.float32).tolist(), int(k % 60 % 3)))
    hot = r.normal(size=16)
    rows += [(1000 + k, (hot + r.normal(size=16) * 0.01).astype(np.float32).tolist(), 1) for k in range(300)]
    rows += [(2000 + k, hot.astype(np.float32).tolist(), 2) for k in range(40)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [None] + [1.0] * 15, 1), (3004, [float("nan")] * 16, 1), (3005, [1.0] * 16, None), (3006, [1.0, 2.0], 1), (3007, [2.0, 4.0], 1), (3008, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*x, "i", "k") for x in rows], SCHEMA)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in near_vectors(df).collect()}
    assert got == brute(rows)


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0, "a", "b"), (1, [1.0, 2.0], 0, "a", "b"), (None, [1.0, 2.0], 0, "a", "b")], SCHEMA)
    got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in near_vectors(df).collect()), key=repr)
    assert got == [(1, 0, 1, True), (1, 0, 1, True), (None, 0, None, True)]
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shape_grows_slowly():
    assert shape(10**3, 0.98)[1] < shape(10**9, 0.98)[1] < 100


def test_components(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 400)] + [(5, 5), (3, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {7: 7} | {k: 7 for k in range(200, 400)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_id_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0), (3, [0.0, 1.0], 1)]
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in near_vectors(spark.createDataFrame([(*x, "i", "k") for x in rows], SCHEMA)).collect())
    # the greatest label and vector of an id stand for it: [1, 0] for 1, and label 1 for 3
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (3, 0, 3)]


def test_a_third_of_all_rows_in_one_class_is_no_task(spark, monkeypatch):
    """Rows of a hot class stay where they are, whatever meets them: no partition of what is kept holds a third of the rows."""
    import random

    from pyspark.sql import functions as F

    from pagemill.llm import embedding_dedup

    r = random.Random(2)
    n = 3000
    rows = [(k, "a", [1.0, 2.0, 3.0, 4.0] if k % 3 == 0 else [r.gauss(0, 1) for _ in range(4)]) for k in range(n)] + [(None, "a", [1.0, 2.0, 3.0, 4.0])] * 500
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(12)
    most = {}

    def spy(rows_, *a, keep=embedding_dedup.kept):
        if "id" in rows_.columns and "node" in rows_.columns:
            counts = [x["count"] for x in rows_.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            most[len(rows_.columns)] = (max(counts), sum(counts))
        return keep(rows_, *a)

    monkeypatch.setattr(embedding_dedup, "kept", spy)
    for key, value in (("spark.sql.shuffle.partitions", "12"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(key, value)
    try:
        found = embedding_dedup.near_vectors(df)
        sizes = [x["count"] for x in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        got = {x.vec_id: x for x in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert most and all(m < total / 4 for m, total in most.values()) and max(sizes) < n / 4
    assert all(got[k].n_links >= n // 3 - 1 and got[k].component_id == 0 for k in range(0, n, 3)) and (got[None].n_links, got[None].component_id) == (0, None)
