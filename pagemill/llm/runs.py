"""Periodic runs of words: a suffix automaton whose link tree is accessed word by word, as link-cut trees are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import free_name

RESULTS = ("n_words", "runs", "collapsed")
RUN = "struct<start:long,length:long,period:long>"
#: An odd factor of the rolling hash, and its inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


class _Powers:
    """Powers of the factor and of its inverse, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (FACTOR, INVERSE))
        return self.up[:n], self.down[:n]


def stretches(hashes: np.ndarray, shortest: int, least: int, powers: _Powers) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of words outside of which there is no run.

    A run is long enough that every gram of `gram` words in it stands in it again one period on or before, and that these cover it. So a run
    lies in what pairs of equal grams cover, where neither of a pair is more than a least-th of the stretch away from the other.
    """
    n, gram = len(hashes), max(1, shortest * (least - 1) // least)
    if n < max(shortest, gram + 1):
        return []
    up, down = powers.upto(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up)])
    grams = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    ordered = np.sort(grams)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    first, second = order[:-1][same], order[1:][same]
    while len(first):
        edge = np.zeros(n + 1, np.int64)
        for at in (first, second):
            np.add.at(edge, at, 1)
            np.add.at(edge, at + gram, -1)
        covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
        turns = np.flatnonzero(covered[1:] != covered[:-1])
        begin, end = turns[::2], turns[1::2]
        k = np.searchsorted(begin, first, side="right") - 1
        near = (second < end[k]) & (least * (second - first) <= (end - begin)[k]) & (shortest <= (end - begin)[k])
        if near.all():
            return list(zip(begin.tolist(), end.tolist(), strict=True))
        first, second = first[near], second[near]
    return []


def _automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length and suffix link of each state of the words' suffix automaton, and the state of each prefix."""
    length, link, after, state = [0], [-1], [{}], []
    last = 0
    for c in words:
        new = len(length)
        length.append(length[last] + 1)
        after.append({})
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                after.append(after[q].copy())
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
        state.append(new)
    return length, link, state


def _heads(length: list[int], link: list[int]) -> list[int]:
    """The top of each state's heavy path: a state is on its parent's path if its subtree is the largest below that."""
    m = len(length)
    order = np.argsort(np.array(length), kind="stable").tolist()
    size, heavy, most = [1] * m, [-1] * m, [0] * m
    for v in reversed(order[1:]):
        p, s = link[v], size[v]
        size[p] += s
        if s > most[p]:
            most[p], heavy[p] = s, v
    head = list(range(m))
    for v in order[1:]:
        p = link[v]
        if heavy[p] == v:
            head[v] = head[p]
    return head


def _agree(w: np.ndarray, at: int, q: int, step: int) -> int:
    """How many words from at on (step 1) or back (step -1) are equal to those q words on."""
    n, size = 0, 32
    while True:
        lo, hi = (at + n, min(at + n + size, len(w) - q)) if step > 0 else (max(0, at - n - size + 1), at - n + 1)
        if lo >= hi:
            return n
        differ = np.flatnonzero(w[lo:hi] != w[lo + q : hi + q])
        if len(differ):
            return n + int(differ[0] if step > 0 else hi - lo - 1 - differ[-1])
        n, size = n + hi - lo, size * 4


def squares(words: list[int], most: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of each maximal run of two periods or more, with a period of most words at most, once; by its period when it is found.

    The links of the finished automaton are replayed word by word. To append word i is to access the state of its prefix: all on the way to the
    root occur last at i from now on. The way is cut into segments of states that last occurred at the same end e; its longest string, of l
    words, then stands at e and at i, so that if i - e <= l the words from e - l + 1 to i have the period i - e. That period is the smallest, or
    the string would have occurred after e; and every run is met at the end of its second period, as its first period occurred last one period
    before. As links don't change, the preferred paths need no balanced trees: on a heavy path an access recolours the upper part, so the
    path's segments are a stack. A way crosses O(log n) heavy paths, and each access leaves a segment on each of them, so all takes O(n log n).
    """
    length, link, state = _automaton(words)
    head = _heads(length, link)
    stacks: dict[int, list[tuple[int, int]]] = {}
    ends: dict[int, int] = {}
    w = np.array(words)
    for i, v in enumerate(state):
        while v > 0:
            h, upto = head[v], length[v]
            stack = stacks.get(h)
            if stack is None:
                stacks[h] = [(upto, i)]
            else:
                met = []
                while stack and stack[-1][0] <= upto:
                    met.append(stack.pop())
                if stack and (not met or met[-1][0] < upto):
                    met.append((upto, stack[-1][1]))
                stack.append((upto, i))
                for l, e in met:
                    q = i - e
                    if q <= l and q <= most and ends.get(q, -1) < i:
                        start = e - l + 1 - _agree(w, e - l, q, -1)
                        end = i + _agree(w, i + 1 - q, q, 1)
                        ends[q] = end
                        yield start, end - start + 1, q
            v = link[h]


def runs_of(words: list[bytes], shortest: int, least: int, powers: _Powers) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of shortest words and least periods or more, by start, then period."""
    n = len(words)
    if n < shortest:
        return []
    found = []
    for begin, end in stretches(np.fromiter(map(hash, words), np.int64, n).view(np.uint64), shortest, least, powers):
        number: dict[bytes, int] = {}
        own = [number.setdefault(x, len(number)) for x in words[begin:end]]
        found += [(begin + s, k, q) for s, k, q in squares(own, (end - begin) // least) if k >= max(shortest, least * q)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(keep).tolist()])


def find_runs(docs: DataFrame, text_col: str = "text", shortest: int = 24, least: int = 3) -> DataFrame:
    """docs with three columns more: n_words, runs (array of start, length, period, counted in words) and collapsed, the text without repeats.

    Words are what ASCII white space separates. A run is a stretch of words with a smallest period q (words q apart are identical) of shortest
    words and least (2 or more) periods at least, that no neighbouring word extends; runs are ordered by start, then period. collapsed has the
    words that no run holds after its first period, joined by one space.

    A null or blank text has no word, no run and an empty collapsed text. Equal rows give equal rows, an empty table an empty table. Columns of
    docs that have the name of a result are replaced by it, others stay. A document is one task's work, whatever its length, as a run may span
    it; nothing is shuffled. Only the words of stretches that repeat themselves within a text enter the automaton.
    """
    if least < 2 or shortest < 2:
        raise ValueError("a run has two periods and two words at least")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in RESULTS])
    raw = free_name(docs, "raw_")
    own = docs.schema
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch.column(batch.num_columns - 1):
                words = (text.as_py() or b"").split()
                found = runs_of(words, shortest, least, powers)
                counts.append(len(words))
                runs.append([{"start": s, "length": k, "period": q} for s, k, q in found])
                texts.append(_collapsed(words, found))
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *RESULTS])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own] + ["n_words long", f"runs array<{RUN}>", "collapsed binary"])
    found = docs.withColumn(raw, F.col(text_col).cast("binary")).mapInArrow(run, schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period, exactly; the first of equals. Null where there is none."""
    better = lambda b, r: b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda b, r: F.when(better(b, r), r).otherwise(b))
