"""Calls that wait do so together, calls that compute one by one."""

from __future__ import annotations

import time

from pagemill.sources.deadline import Failed, Overdue, overlapped


def _work(x):
    if x == "hang":
        time.sleep(60)
    if x == "slow":
        time.sleep(0.3)
    if x == "bad":
        raise ValueError("bad input")
    if x == "spin":
        end = time.process_time() + 0.4
        while time.process_time() < end:
            pass
    return x.upper()


def test_hanging_calls_wait_together():
    asked = ["hang", "a", "bad", "hang", "slow", "hang", "b", "hang", "spin", "hang", "hang"]
    began = time.monotonic()
    told = {k: (v, type(e)) for k, v, e in overlapped({"f": _work}, ((k, "f", (x,), 1.5 if x == "hang" else 20.0) for k, x in enumerate(asked)))}
    assert time.monotonic() - began < 5  # six times 1.5 seconds one after another
    assert told == {k: (None, Overdue) if x == "hang" else (None, Failed) if x == "bad" else (x.upper(), type(None)) for k, x in enumerate(asked)}


def test_more_hang_than_are_left_aside_and_calls_without_a_limit():
    asked = ["hang"] * 5 + ["a", "b"]
    told = list(overlapped({"f": _work}, ((k, "f", (x,), 0.4 if x == "hang" else None) for k, x in enumerate(asked)), aside=2))
    assert sorted(k for k, *_ in told) == list(range(7)) and sum(isinstance(e, Overdue) for *_, e in told) == 5
    assert {v for _, v, _ in told} == {None, "A", "B"}
