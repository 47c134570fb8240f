"""What tasks hold of a batch is bounded whatever the batch has."""

from __future__ import annotations

import pyarrow as pa
from pagemill.llm.memory import by_parts


def test_a_batch_is_worked_on_in_parts_and_told_whole():
    seen = []

    def of(a, b):
        seen.append((len(a), len(b)))
        return pa.array([x + y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())

    batches = [(pa.array(range(25)), pa.array(range(25))), (pa.array([], pa.int64()), pa.array([], pa.int64()))]
    told = list(by_parts(of, iter(batches), pa.int64(), rows=10))
    assert seen == [(10, 10), (10, 10), (5, 5)]
    assert [t.to_pylist() for t in told] == [[2 * k for k in range(25)], []]


def test_texts_are_cut_in_parts(monkeypatch):
    from pagemill.llm import unit_dedup

    seen = []
    spied = lambda of, *rest: by_parts(lambda *c: seen.append(len(c[0])) or of(*c), *rest)
    monkeypatch.setattr(unit_dedup, "by_parts", spied)
    spans = pa.array([[{"start": 1, "end": 3}], None, []] * 1000, unit_dedup._SPANS)
    told = list(unit_dedup._without(iter([(pa.array(["abcd", None, "ef"] * 1000), spans)])))
    assert [t.to_pylist() for t in told] == [["ad", None, "ef"] * 1000] and seen == [1000] * 3
