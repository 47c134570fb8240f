import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm.queries import op12_periodic_runs
from pagemill.llm.runs import _Powers, find_runs, runs_of, squares


def brute(words, shortest=24, least=3):
    """By the definition: every stretch of each period that can't be extended, unless a smaller period fits it."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            s, k = i - q, j - (i - q)
            smaller = any(all(words[x] == words[x - p] for x in range(s + p, s + k)) for p in range(1, q))
            if k >= max(shortest, least * q) and not smaller:
                found.append((s, k, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def ours(words, shortest=24, least=3):
    return runs_of([str(w).encode() for w in words], shortest, least, _Powers())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=90), st.sampled_from([(24, 3), (4, 2), (2, 2), (6, 4), (9, 3)]))
def test_two_words(words, bounds):
    assert ours(words, *bounds) == brute(words, *bounds)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 7)), max_size=8))
def test_runs_of_runs(parts):
    words = [w for p, k in parts for w in p * k]
    assert ours(words) == brute(words)
    assert ours(words, 3, 2) == brute(words, 3, 2)


def test_every_square_is_found_once():
    random.seed(5)
    for _ in range(100):
        words = [random.choice("ab" * 3 + "c") for _ in range(60)]
        number = {"a": 0, "b": 1, "c": 2}
        got = list(squares([number[x] for x in words], 30))
        assert len(got) == len(set(got)) and sorted(got, key=lambda r: (r[0], r[2])) == brute(words, 2, 2)


def test_long_period_and_long_text():
    base = list(range(5000))
    assert ours(base * 3 + [1]) == [(0, 15000, 5000)]
    assert ours([9, 8] * 60000) == [(0, 120000, 2)]
    assert ours(base + [1, 2] * 11 + base) == [] and ours(base + [1, 2] * 12 + base) == [(5000, 24, 2)]


def test_equal_hashes_are_told_apart():
    class Same(bytes):
        def __hash__(self):
            return 1

    words = [Same(str(k).encode()) for k in range(40)]
    assert runs_of(words, 24, 3, _Powers()) == []


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a b " * 20, "x"), (4, "a b " * 20, "x"), (None, "a b " * 24, "y"), (6, "no run here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Runs string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(df).collect()), key=repr)
    assert got == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 40, [(0, 40, 2)], "a b"), (4, 40, [(0, 40, 2)], "a b"), (None, 24, [(0, 24, 1)], "a b"), (6, 3, [], "no run here")], key=repr)
    assert find_runs(df).columns == ["doc_id", "text", "n_words", "runs", "collapsed"] and find_runs(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        find_runs(df, least=1)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op12_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got.values()) > 5
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h = zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = vector_brute(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        drop = {k for s, length, q in runs for k in range(s + q, s + length)}
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in drop).encode()).hexdigest()


def vector_brute(words, shortest=24, least=3):
    """brute for long texts."""
    number = {}
    w = np.array([number.setdefault(x, len(number)) for x in words])
    found = []
    for q in range(1, len(w) // least + 1):
        same = np.concatenate([[False], w[q:] == w[:-q], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if e - s + q >= max(shortest, least * q) and not any((w[s + p : e + q] == w[s : e + q - p]).all() for p in range(1, q)):
                found.append((s, e - s + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))
