"""Grams of a few texts at a time."""

from __future__ import annotations

from pagemill.llm.repeats import HASHED, _batches_of


def test_bytes_hashed_at_once_are_bounded():
    texts = [b"x" * 1000] * 2000 + [b"y" * (HASHED + 1)] + [b"z"] * 3
    told = list(_batches_of(texts))
    assert HASHED <= 1 << 19 and all(len(data) <= HASHED or len(ends) == 1 for _, data, _, ends in told)
    assert [first for first, *_ in told] == sorted({first for first, *_ in told}) and sum(len(ends) for *_, ends in told) == len(texts)
    assert b"".join(data.tobytes() for _, data, *_ in told) == b"".join(texts)
