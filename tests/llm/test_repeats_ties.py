import random

from test_repeats import brute, run, words

from pagemill.llm import repeats


def test_one_passage_behind_different_texts(spark, monkeypatch):
    """Contexts that are equal to one side are dealt over partitions, not held in one."""
    r = random.Random(3)
    passage = words(r, 700)
    rows = [(k, words(r, 180) + passage + words(r, 180)) for k in range(300)]
    largest, edges = {}, repeats._edges

    def spy(dealt, side):
        for row in dealt.groupBy("gram", side).count().orderBy("count", ascending=False).limit(1).collect():
            same = dealt.where((dealt["gram"] == row["gram"]) & (dealt[side] == row[side]))
            largest[side] = (row["count"], max(x["count"] for x in same.groupBy("part").count().collect()), max(x["count"] for x in dealt.groupBy("part").count().collect()))
        return edges(dealt, side)

    monkeypatch.setattr(repeats, "_edges", spy)
    monkeypatch.setattr(repeats, "IN_PART", 30, raising=False)
    assert run(spark, rows, hot=20) == brute(rows)
    for equal, together, part in largest.values():
        assert equal > 200 and together < 100 and part < 100
    assert set(largest) == {"after", "before"}
