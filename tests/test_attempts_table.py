"""The ladder over tables of attempts against the ladder that climbs them one by one."""

from __future__ import annotations

import random

import pytest
from pagemill.config import OcrKnobs
from pagemill.operators.attempts import climbed
from pagemill.sources.ladder import Reading, Rung, climb, later_rungs


def by_hand(rows, knobs):
    own = dict(zip([Rung("orig", knobs.mode), *later_rungs(knobs)], sorted(rows), strict=False))

    def look(rung):
        _, confidence, words, chars, failed = own[rung]
        if failed:
            raise RuntimeError("the attempt failed")
        return Reading("x" * chars, confidence, words)

    found = climb(look, own.__contains__, knobs)
    return own[found.rung][0] if found.rung else None, round(found.score, 9) if found.rung else None, found.made, found.failed


@pytest.mark.parametrize("knobs", [OcrKnobs(max_attempts=k) for k in (1, 2, 3, 4, 9)] + [OcrKnobs(mode=6, second_mode=6, max_attempts=4), OcrKnobs(rotate=True)])
def test_pages_of_random_attempts(spark, knobs):
    rng = random.Random(5)
    pages = {
        p: [(a, rng.choice([10.0, 60.0, 78.0, 95.0, 140.0, float("nan")]), rng.choice([0, 5, 30, 80]), rng.choice([-3, 0, 299, 300, 9000]), rng.random() < 0.25) for a in rng.sample(range(1, 9), rng.randint(1, 6))]
        for p in range(300)
    }
    rows = [(p, *a) for p, own in pages.items() for a in own]
    df = spark.createDataFrame(rows, "page long, attempt int, confidence double, words long, chars long, failed boolean")
    told = {r["page"]: (r["attempt"], r["score"] if r["score"] is None else round(r["score"], 9), r["made"], r["failed"]) for r in climbed(df, "page", knobs).collect()}
    assert told == {p: by_hand(own, knobs) for p, own in pages.items()}


def test_attempts_without_a_figure_fail_and_run_without_python(spark):
    rows = [(1, 1, None, 30, 400, False), (2, 1, 50.0, 30, 400, None), (2, 2, 90.0, None, 400, False), (2, 3, 90.0, 30, None, False)]
    found = climbed(spark.createDataFrame(rows, "page long, attempt int, confidence double, words long, chars long, failed boolean"), "page", OcrKnobs(max_attempts=3))
    assert {(r["page"], r["attempt"], r["made"], r["failed"]) for r in found.collect()} == {(1, None, 1, 1), (2, 1, 3, 2)}
    assert "Python" not in (plan := found._jdf.queryExecution().toString()) and "Arrow" not in plan
