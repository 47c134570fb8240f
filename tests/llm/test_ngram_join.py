import random
import re

import numpy as np

from pagemill.llm.ngram_join import near_texts, runs_needed
from pagemill.llm.shingles import intersections, shingle_sets


def shingles(text):
    w = [x for x in re.split(r"[ \t\n\v\f\r]+", text or "") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts, threshold=0.8):
    """(class, links) of each id, all pairs compared."""
    sets = {d: shingles(t) for d, t in texts.items()}
    links = {d: set() for d in sets}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    for d, s in sets.items():
        seen = {}
        for x in s:
            for y in holders[x]:
                seen[y] = seen.get(y, 0) + 1
        links[d] = {y for y, k in seen.items() if y != d and k / (len(s) + len(sets[y]) - k) >= threshold}
    low = {d: d for d in sets}
    while True:
        new = {d: min([low[d], *(low[y] for y in links[d])]) for d in sets}
        if new == low:
            return {d: (low[d], len(links[d])) for d in sets}
        low = new


def test_sets_and_intersections():
    texts = ["", "  ", "a b", "a b c d e f a b c d e f", "a\tb\nc d  e", "x" * 100, "é ü 漢 字 z q"]
    got = shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert (got[4] == np.intersect1d(got[4], got[3])).all()
    r = random.Random(2)
    many = [" ".join(r.choice("abcdef") for _ in range(r.randint(0, 60))) for _ in range(40)]
    sets = shingle_sets([t.encode() for t in many])
    a = np.arange(40)
    both = intersections(sets, a, a, width=7)
    assert all(both[i, j] == len(shingles(many[i]) & shingles(many[j])) for i in range(40) for j in range(40) if i != j)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    common = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(r.randint(1, 160))] + ([common] if r.random() < 0.4 else [])
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            near = base.copy()
            for _ in range(r.randint(0, max(1, len(near) // 25))):
                near[r.randrange(len(near))] = word()
            texts.append(" ".join(near))
    group = [word() for _ in range(150)]  # one large group of near copies, beyond a block
    for k in range(330):
        near = group.copy()
        near[k % 150] = word()
        texts.append(" ".join(near))
    return texts


def test_against_all_pairs(spark):
    texts = dict(enumerate(corpus(5)))
    texts |= {9000: None, 9001: "", 9002: "one two", 9003: "one  two", 9004: "long " + " ".join(map(str, range(60_000))), 9005: "long " + " ".join(map(str, range(60_000)))}
    df = spark.createDataFrame([(d, t, "x", d) for d, t in texts.items()], "doc_id long, text string, class_id string, node long")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_texts(df).collect()}
    assert got == brute(texts)
    small = {r.doc_id: (r.class_id, r.n_links) for r in near_texts(df, small=2, depth=2).collect()}
    assert small == got


def test_repeated_and_null_ids(spark):
    same = " ".join("abcdefghij")
    df = spark.createDataFrame([(1, same), (1, same), (2, same), (None, same), (3, "other words in this text here")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in near_texts(df).collect()), key=repr)
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 3, 0), (None, None, 0)]


def test_empty(spark):
    assert near_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs():
    assert runs_needed(miss=1e-6) > runs_needed() >= 5


def test_one_id_with_different_texts(spark):
    a, b = " ".join("abcdefghij"), " ".join("zyxwvutsrq")
    rows = [(1, a), (1, b), (2, a), (3, b), (3, None)]
    got = sorted((r.doc_id, r.class_id, r.n_links, r.text or "") for r in near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # the greatest text of an id stands for it, and both of its rows get the result
    assert [x[:3] for x in got] == [(1, 1, 1), (1, 1, 1), (2, 2, 0), (3, 1, 1), (3, 1, 1)] and {x[3] for x in got} == {a, b, ""}


def test_dropping_near_texts(spark):
    """drop_near gives the rows that near_texts' classes keep, with every column and rows without an id."""
    from pagemill.llm.ngram_join import drop_near, near_texts

    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[: 40 + k % 7]) if k % 2 else f"other text {k} " * (k + 1), k % 3) for k in range(40)] + [(None, " ".join(words[:40]), 1), (None, None, 2), (7, "twice " * 9, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id_ long")
    want = near_texts(df).where("doc_id IS NULL OR doc_id = class_id").select(*df.columns)
    got = drop_near(df)
    order = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert got.columns == df.columns and order(got) == order(want) and got.count() < df.count()
    assert drop_near(df.where("false")).count() == 0
