import pytest

import corpus_pipeline
from pagemill.llm.queries import ORACLE_SQL, QUERIES
from pagemill.llm.tables import kept


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_what_its_sql_gives(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_pipeline_stages(spark, sf):
    """Each stage's rows are held against a plain computation on what the stage was given."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(10**6, None, "en", None, 0), (10**6 + 1, "12 34", None, "src1", 5), (10**6 + 2, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(odd)
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = kept(stage(spark, docs, sf))
        steps[name] = (before, docs)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = steps["language id"]
    assert set(ids(before)) - set(ids(after)) == {10**6, 10**6 + 1, 10**6 + 2} and after.columns == columns
    before, after = steps["exact dedup"]
    best = {}
    for r in before.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert ids(after) == sorted(best.values())
    before, after = steps["n-gram jaccard join"]
    classes = brute_classes({r.doc_id: r.text for r in before.collect()})
    assert ids(after) == sorted(d for d, (c, _) in classes.items() if c == d)
    before, after = steps["mixing"]
    assert after.columns == columns and set(ids(after)) <= set(ids(before)) and max(ids(after).count(d) for d in set(ids(after))) <= 2
    words = lambda df: {s: sum(len(x.text.split()) for x in rows) for s, rows in by_source(df).items()}
    share = sum(words(after).values()) / sum(words(before).values())
    assert 1.4 < share < 1.6
    before, after = steps["packing"]
    assert sorted(set(ids(after))) == sorted(set(ids(before)))
    assert max(r.n for r in after.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").collect()) <= 1024


def test_pipeline_on_an_empty_table_and_with_clashing_columns(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    names = ["score", "Kept", "class_id", "taken", "id_", "size", "keep_id", "lang_pred", "start", "result_", "place_", "uid_"]
    odd = docs.selectExpr("*", *[f"'{n}' AS {n}" for n in names])
    odd.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    folder = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    rows = folder
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = kept(stage(spark, rows, str(tmp_path / "odd")))
        assert rows.columns == folder.columns, name
        assert {tuple(r) for r in rows.select(*names).distinct().collect()} == {tuple(names)}, name
    plain = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain = kept(stage(spark, plain, sf))
    assert sorted(r.doc_id for r in rows.select("doc_id").collect()) == sorted(r.doc_id for r in plain.select("doc_id").collect())


def by_source(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.source, []).append(r)
    return out


def brute_classes(texts):
    from test_ngram_join import brute

    return brute(texts)
