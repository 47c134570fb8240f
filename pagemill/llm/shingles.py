"""Hashes of word shingles of many texts at once, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Words in a shingle.
WORDS = 5
#: Bytes that are hashed side by side.
SIDE_BY_SIDE = 1 << 21
#: White space between words: the ASCII kinds.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    up, down = np.full(n, _BASE), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def forget() -> None:
    """Frees the powers."""
    _powers.cache_clear()


def range_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each data[begin:end], equal for equal bytes."""
    size = 1 << max(10, int(len(data)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _word_shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts data[starts:ends], one after another, and the text of each."""
    solid = ~SPACE[data]
    # texts follow one another; a word also ends where its text does
    first, last = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    first[starts], last[ends] = True, True
    before = np.concatenate(([False], solid))[: len(data)]
    begin = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.concatenate((solid[1:], [False]))
    end = np.flatnonzero(solid & (~after | last[1:])) + 1
    words = range_hashes(data, begin, end)
    text = np.searchsorted(ends, begin, side="right")
    count = np.bincount(text, minlength=len(starts))
    at = np.cumsum(count) - count
    shingles = np.where(count == 0, 0, np.maximum(count - WORDS + 1, 1))
    of = np.repeat(np.arange(len(starts)), shingles)
    place = at[of] + np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    value = np.zeros(len(of), np.uint64)
    for k in range(WORDS):
        inside = k < count[of]  # a text of fewer words is one shingle
        word = words[np.minimum(place + k, max(len(words) - 1, 0))] if len(words) else np.zeros(len(of), np.uint64)
        value = mix(value * np.uint64(31) + np.where(inside, word, np.uint64(0)) + np.uint64(k + 1))
    return value, of


def shingle_sets(texts: list[bytes], together: int = SIDE_BY_SIDE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of five words in a row, or of all words where there are fewer. So many bytes are hashed at once,
    which takes some sixty times as much memory; a longer text is hashed by itself."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        group, size = [], 0
        while k < len(texts) and (not group or size + len(texts[k]) <= together):
            group.append(texts[k])
            size += len(texts[k])
            k += 1
        data = np.frombuffer(b"".join(group), np.uint8)
        lengths = np.array([len(x) for x in group])
        ends = np.cumsum(lengths)
        # empty texts have no bytes, so only the others take part
        full = np.flatnonzero(lengths)
        sets = [np.zeros(0, np.uint64)] * len(group)
        if len(full):
            value, of = _word_shingles(data, ends[full] - lengths[full], ends[full])
            edges = np.searchsorted(of, np.arange(len(full) + 1))
            for i, t in enumerate(full.tolist()):
                sets[t] = np.unique(value[edges[i] : edges[i + 1]])
        out += sets
    return out


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of the sets of a with those of b; columns for shared elements, some at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    use = shared[column]
    owner, column = owner[use], (np.cumsum(shared) - 1)[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(a), len(b)), np.float64)
    for begin in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [begin, begin + width])
        inside = np.zeros((len(sets), min(width, int(shared.sum()) - begin)), np.float32)
        inside[owner[lo:hi], column[lo:hi] - begin] = 1
        total += inside[a] @ inside[b].T
    return total
