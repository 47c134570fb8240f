import hashlib
import random
from collections import Counter

import pytest

from pagemill.llm import repeats
from pagemill.llm.repeats import drop_repeats


def brute(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + 200] for _, b in data for k in range(len(b) - 199))
    out = []
    for i, b in data:
        mark = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                mark[k : k + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(mark)) if mark[k] and (not k or not mark[k - 1]))
        left = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((i, len(b), sum(mark), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, spans string, doc string")
    told = drop_repeats(df, **more).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), r.kept_sha256) for r in told), key=repr)


def words(r, n):
    return "".join(r.choice("abcdé ") for _ in range(n))


@pytest.mark.parametrize("partitions, hot, whole", [("3", 65536, 8192), ("3", 65536, 6), ("3", 8, 8192), ("40", 8, 4)])
def test_against_all_strings(spark, monkeypatch, partitions, hot, whole):
    monkeypatch.setattr(repeats, "WHOLE", whole)
    r = random.Random(9)
    passage, short, group = words(r, 320), words(r, 195), words(r, 900)
    rows = [(k, words(r, r.randint(0, 500)) + passage[r.randint(0, 40) : r.randint(230, 320)] + words(r, r.randint(0, 300))) for k in range(40)]
    rows += [(100 + k, words(r, 100) + short + words(r, 150)) for k in range(10)]
    for k in range(60):
        near = list(group)
        near[(k * 37) % 900] = "Z"
        rows.append((200 + k, "".join(near)))
    rows += [(300, "x" * 1000), (301, "ab" * 400), (302, None), (303, ""), (304, "y" * 199), (305, words(r, 200)), (306, passage), (306, passage), (None, words(r, 400)), (None, group[:500])]
    rows += [(400, (twice := words(r, 230)) + "---" + twice), (401, words(r, 60_000))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, rows, hot=hot) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_nothing(spark):
    assert run(spark, [(1, "a")]) == brute([(1, "a")])
    assert drop_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
