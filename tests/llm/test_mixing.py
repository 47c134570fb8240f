import re

from pagemill.llm.mixing import mix_sources, source_targets

SCHEMA = "doc_id long, text string, source string, size string, place_ int"


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets(spark):
    for sizes in ({"a": 100, "b": 100, None: 100}, {"a": 1000, "b": 10, "c": 10, "é": 10, "Z": 300}, {"a": 0, "b": 5}, {"only": 7}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want), (got, want)


def test_mix(spark):
    rows = [(k, "w " * (k % 40), f"s{k % 5 if k % 3 else 0}", "x", 1) for k in range(1500)]
    rows += [(5000, None, "s1", "x", 2), (5001, "a\x0bb\xa0c", None, "x", 3), (5002, "one two", None, None, 4), (None, "x y z", "s2", None, 5), (7, "w " * 7, "s2", "x", 1)]
    df = mix_sources(spark.createDataFrame(rows, SCHEMA))
    got = df.collect()
    assert len(got) == len(rows) and [r for r in sorted(r.place_ for r in got)][-1] == 5
    sizes = {}
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))
        assert r.size == n and r.taken in (0, n, 2 * n)
        sizes[r.source] = sizes.get(r.source, 0) + n
    want = plain_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own)
    again = {(r.doc_id, r.text): r.taken for r in mix_sources(spark.createDataFrame(rows[::-1], SCHEMA)).collect()}
    assert again == {(r.doc_id, r.text): r.taken for r in got}


def test_repeated_ids_and_rows(spark, monkeypatch):
    """A source of rows of one id, with texts of their own, with some equal, and with all equal: the target is met within half a document."""
    rows = [(7, "w " * (k % 9 + 1), "a", "x", 1) for k in range(750)]  # one id
    rows += [(8, "same " * 6, "b", "x", 1) for _ in range(750)]  # one row again and again
    rows += [(9, "w " * (k % 3 + 1) + ("z" if k % 2 else ""), "c", "x", 1) for k in range(600)] + [(k, "w " * 5, "c", "x", 1) for k in range(1000, 1300)]
    rows += [(k, "u " * 4, None, "x", 1) for k in range(2000, 2300)]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert len(got) == len(rows)
    for s in ("a", "b", "c", None):
        own = [r for r in got if r.source == s]
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own), s
    order = lambda rs: sorted(((r.doc_id, r.text, r.taken) for r in rs), key=repr)
    assert order(mix_sources(spark.createDataFrame(rows[::-1], SCHEMA)).collect()) == order(got)


def test_query_with_repeated_ids_gives_what_its_sql_gives(spark, tmp_path):
    import duckdb

    from pagemill.llm.queries import ORACLE_SQL, op3_mix_sources

    rows = [(k % 5, "w " * (k % 7), f"s{k % 3}") for k in range(700)] + [(99, "same text", "s4")] * 300 + [(100, None, None), (None, "x y", None), (None, "x y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in op3_mix_sources(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL["op3_mix_sources"])
    names = [d[0] for d in want.description]
    assert names == ["doc_id", "size", "source_size", "target", "taken"]
    assert got == sorted(want.fetchall(), key=repr)


def test_nothing_to_take(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    (r,) = mix_sources(spark.createDataFrame([(1, None, None, None, 0)], SCHEMA)).collect()
    assert (r.size, r.source_size, r.taken) == (0, 0, 0)
