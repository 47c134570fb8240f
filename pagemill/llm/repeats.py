"""Suffix-array dedup: maximal repeats found with a sampled enhanced suffix array over all documents, and the bytes of strings that occur again.

Every string of LENGTH bytes holds an anchor: a gram whose hash is the least in it. Equal strings have equal anchors at the same
place, so two of them meet where anchors of one gram are compared: they are equal if what the anchors share to the left and what they share
to the right come to LENGTH bytes. Anchors of grams that occur once are left out, and contexts that are equal through and through are one leaf
with its number of occurrences. The others are sorted: by gram and right context, and by gram and left context. Either order is a
suffix array, in parts by gram, or by range where a gram is very common; a scan with a stack of common-prefix lengths walks its tree of intervals.
The occurrences of an interval part where they differ to the left: those that agree for LENGTH bytes are a group, how far all
of it agree to the left, and to the right, tells the maximal repeat, and what is removed comes of the groups that an occurrence is in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import shared_folder
from .bloom import likely_in
from .memory import by_parts, in_parts, lean
from .shingles import mix, range_hashes
from .tables import free_name, join_groups, kept

#: Bytes of a string that may not occur again, and of the gram at an anchor.
LENGTH, GRAM = 200, 32
#: An anchor lies so many bytes after a string's start at most.
REACH = LENGTH - GRAM
#: A gram with more different contexts is dealt over several tasks; contexts of others are compared so many at a time, whole grams each.
HOT, TOGETHER = 65536, 4096
#: Strings of more contexts than this are compared in PARTS parts by their digests, one after another.
WHOLE, PARTS = 8192, 16
#: Bytes of a text whose spans are joined first.
STRETCH = 4096
#: Contexts of very common grams in a partition, about.
IN_PART = 16384
#: Bytes of texts whose grams are hashed at once, which takes some hundred times as much memory; a longer text is hashed by itself.
HASHED = 1 << 19

_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or greatest of each width values in a row, by running extremes of blocks from both ends."""
    f, fill = (np.minimum, _MOST) if least else (np.maximum, np.uint64(0))
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, fill, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = f.accumulate(blocks, axis=1).ravel()
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, gram hash) of the anchors of texts data[starts:ends], which follow one another."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    at = np.arange(n - GRAM + 1)
    grams = range_hashes(data, at, at + GRAM) >> np.uint64(1)
    left = np.repeat(ends, ends - starts)[: n] - np.arange(n)  # bytes from here to the text's end
    grams[left[: len(grams)] < GRAM] = _MOST
    least = _sliding(grams, REACH + 1, least=True)
    least[left[: len(least)] < LENGTH] = 0
    # a gram is an anchor if it is the least of some string that holds it: the greatest of those leasts is the gram itself
    padded = np.concatenate((np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)))
    place = np.flatnonzero((_sliding(padded, REACH + 1, least=False)[: len(grams)] == grams) & (grams != _MOST))
    text = np.searchsorted(ends, place, side="right")
    return text, place, grams[place]


def _batches_of(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, data, starts, ends): texts one after another, some at a time."""
    k = 0
    while k < len(texts):
        first, size = k, 0
        while k < len(texts) and (k == first or size + len(texts[k]) <= HASHED):
            size += len(texts[k])
            k += 1
        ends = np.cumsum([len(x) for x in texts[first:k]])
        yield first, np.frombuffer(b"".join(texts[first:k]), np.uint8), ends - np.array([len(x) for x in texts[first:k]]), ends


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, pos, before, after, gram, context) of docs (doc, text_hash, bytes): each anchor, how many bytes of its context
    the text has left and right of it, and digests of the gram and of the context."""
    names = ["doc", "text_hash", "pos", "before", "after", "gram", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            texts = batch.column(2).to_pylist()
            for first, data, starts, ends in _batches_of(texts):
                text, place, gram = anchors(data, starts, ends)
                begin, end = np.maximum(starts[text], place - REACH), np.minimum(ends[text], place + LENGTH)
                context = mix(range_hashes(data, begin, place) * np.uint64(31) + range_hashes(data, place, end))
                rows = pa.array(text + first)
                sizes = (pa.array(x.astype(np.int16)) for x in (place - begin, end - place))
                arrays = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((place - starts[text]).astype(np.int32)), *sizes, *(pa.array(x.view(np.int64)) for x in (gram, context))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(lean(run), "doc long, text_hash int, pos int, before short, after short, gram long, context long")


def _contexts(wanted: DataFrame) -> DataFrame:
    """(gram, context, times, before, after), the last two as bytes and the left one backwards, of (bytes, wanted: array of pos, gram, context, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            rows = [
                (w["gram"], w["context"], w["times"], text[max(0, w["pos"] - REACH) : w["pos"]][::-1], text[w["pos"] : w["pos"] + LENGTH])
                for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for w in own
            ]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["gram", "context", "times", "before", "after"])

    return wanted.mapInArrow(lean(run), "gram long, context long, times long, before binary, after binary")


def common_prefixes(strings: list[bytes]) -> np.ndarray:
    """The length of the common prefix of each string with the one before it; 0 for the first."""
    lengths = np.array([len(s) for s in strings])
    wide = max(1, int(lengths.max(initial=0)))
    padded = np.zeros((len(strings), wide), np.uint8)
    padded[np.arange(wide)[None] < lengths[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    out = np.zeros(len(strings), np.int64)
    if len(strings) > 1:
        differ = padded[1:] != padded[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        out[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return out


def chains(prefixes: list[int], stack: list[int]) -> tuple[list[list[int]], list[int]]:
    """The depths of the intervals that hold each row and one before it: the running least prefixes, kept on a stack.

    prefixes: with the row before; -1 where another gram begins. stack: depths that reach into what came before. Also the last stack.
    """
    out = []
    for p in prefixes:
        while stack and stack[-1] > p:
            stack.pop()
        if p >= 0 and (not stack or stack[-1] < p):
            stack.append(p)
        out.append(stack.copy())
    return out, stack


def _prefixes(grams: np.ndarray, strings: list[bytes], last: tuple[int, bytes] | None) -> list[int]:
    """Common prefixes of rows with the rows before them, last being before the first; -1 where there is none of the same gram."""
    found = common_prefixes([last[1] if last else b"", *strings])[1:]
    same = np.concatenate(([bool(last) and last[0] == grams[0]], grams[1:] == grams[:-1]))
    return np.where(same, found, -1).tolist()


def _edges(rows: DataFrame, side: str) -> list[tuple]:
    """For each partition that has rows: its number, first and last row, and the stacks that a scan from either end leaves.

    What comes to the driver is a few hundred bytes for each partition, however many rows there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = part = None
        ahead: list[int] = []
        back: list[int] = []
        least, broken = LENGTH + 1, False
        for batch in batches:
            if not batch.num_rows:
                continue
            grams, strings = batch.column("gram").to_numpy(), batch.column(side).to_pylist()
            found = _prefixes(grams, strings, last)
            if first is None:
                first, found = (int(grams[0]), strings[0]), found[1:]
                part = batch.column("part")[0].as_py()
            _, ahead = chains(found, ahead)
            for p in found:
                if broken:
                    break
                broken = p < 0
                if not broken and p < least:
                    least = p
                    back.append(p)
            last = (int(grams[-1]), strings[-1])
        if first is not None:
            columns = [[part], [first[0]], [first[1]], [last[0]], [last[1]], [ahead], [back[::-1]], [broken]]
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["p", "g0", "s0", "g1", "s1", "ahead", "back", "broken"])

    found = rows.mapInArrow(run, "p int, g0 long, s0 binary, g1 long, s1 binary, ahead array<int>, back array<int>, broken boolean")
    return sorted(tuple(r) for r in found.collect())


def _reaching(edges: list[tuple]) -> dict[int, tuple[list[int], list[int]]]:
    """For each partition the depths that reach into partitions before it, and after it."""

    def walk(parts: list[tuple], forward: bool) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        stack: list[int] = []
        for k, part in enumerate(parts):
            p, g0, s0, g1, s1, ahead, back, broken = part
            if k:
                before = parts[k - 1]
                a, b = ((before[3], before[4]), (g0, s0)) if forward else ((g1, s1), (before[1], before[2]))
                edge = int(common_prefixes([bytes(a[1]), bytes(b[1])])[1]) if a[0] == b[0] else -1
                _, stack = chains([edge], stack)
            out[p] = stack.copy()
            inside = ahead if forward else back
            if broken:
                stack = list(inside)
            elif inside:  # depths of this partition over what is left of those from before
                stack = [d for d in stack if d < inside[0]] + list(inside)
        return out

    first, then = walk(edges, True), walk(edges[::-1], False)
    return {p: (first[p], then[p]) for p in first}


def _key_strings(rows: pa.Table, depths: list[tuple[list[int], list[int]]], side: str, anchored: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, delta, x, y), some rows at a time: for each row and each depth of an interval that it hangs in, a digest of the string of
    LENGTH bytes that begins delta bytes before the anchor. Contexts that share such a string part at a depth of both: it is theirs to find."""
    befores, afters = rows["before"].to_pylist(), rows["after"].to_pylist()
    for begin in range(0, len(befores), 4096):
        buffer, at, row, delta, size = [], [], [], [], 0
        for k in range(begin, min(begin + 4096, len(befores))):
            before, after = befores[k], afters[k]
            for depth in {*depths[k][0], *depths[k][1]}:
                d = LENGTH - depth if side == "after" else depth
                if 0 <= d <= len(before) and LENGTH - d <= len(after):
                    at.append(size + len(before) - d)
                    row.append(k)
                    delta.append(d)
            buffer += [before[::-1], after]
            size += len(before) + len(after)
        if at:
            data, begins, deltas = np.frombuffer(b"".join(buffer), np.uint8), np.array(at), np.array(delta, np.int64)
            if anchored:
                parts = [_anchored(data, begins[k : k + 4096], begins[k : k + 4096] + LENGTH, deltas[k : k + 4096]) for k in range(0, len(begins), 4096)]
                keep = np.concatenate(parts)
                begins, deltas, row = begins[keep], deltas[keep], np.array(row)[keep]
                if not len(begins):
                    continue
            x = mix(range_hashes(data, begins, begins + LENGTH) + deltas.astype(np.uint64))
            y = mix(range_hashes(_OTHER[data], begins, begins + LENGTH) - deltas.astype(np.uint64))
            yield np.array(row), deltas, x, y


def _depths(rows: pa.Table, side: str, ahead: list[int], back: list[int]) -> list[tuple[list[int], list[int]]]:
    """The depths of intervals that hold each of rows, in order of gram and side, and a row before it or after it."""
    found = _prefixes(rows["gram"].to_numpy(), rows[side].to_pylist(), None)
    before, _ = chains(found[1:], ahead.copy())
    after, _ = chains(found[:0:-1], back.copy())
    return list(zip([ahead, *before], [*after[::-1], back], strict=True))


def _square(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of width bytes at most as rows of bytes, and their lengths."""
    lengths = np.array([len(x) for x in strings])
    rows = np.zeros((len(strings), width), np.uint8)
    rows[np.arange(width)[None] < lengths[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    return rows, lengths


def _shared(rows: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common prefix of each row of a with that of b."""
    out = np.zeros(len(a), np.int16)
    for k in range(0, len(a), 4096):
        one, two = a[k : k + 4096], b[k : k + 4096]
        differ = rows[one] != rows[two]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[k : k + 4096] = np.minimum(first, np.minimum(lengths[one], lengths[two]))
    return out


def _anchored(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the gram at a place of each string data[begins:ends] is the least of some LENGTH bytes of it: then all that hold the string have that anchor."""
    n = int((ends - begins).max()) - GRAM + 1
    place = begins[:, None] + np.arange(n)[None]
    inside = place + GRAM <= ends[:, None]
    start = np.where(inside, place, begins[:, None])
    grams = (range_hashes(data, start.ravel(), start.ravel() + GRAM) >> np.uint64(1)).reshape(start.shape)
    own = grams[np.arange(len(at)), at]
    smaller = (grams < own[:, None]) & inside
    column = np.arange(n)[None]
    before = np.where(smaller & (column < at[:, None]), column, -1).max(axis=1)
    after = np.where((smaller | ~inside) & (column > at[:, None]), column, n).min(axis=1)
    return after - before - 1 > REACH


def farthest_of(row: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the entries that go farthest to the left, and to the right, of those of their row."""
    out = []
    for reach in (left, right) if len(row) else ():
        order = np.lexsort((-reach, row))
        out.append(order[np.concatenate(([True], row[order][1:] != row[order][:-1]))])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def maximal_groups(befores: list[bytes], afters: list[bytes], row: np.ndarray, delta: np.ndarray, x: np.ndarray, complete: bool = False) -> tuple[np.ndarray, ...]:
    """(row, group, left, right) of the maximal repeats among the strings of LENGTH bytes that begin delta bytes before the anchors of rows.

    If complete, all are given whose anchor comes of what is repeated, so that no occurrence has other anchors alone. Else each row gets two at
    most: those that go farthest to the left and to the right of its anchor, between which all others lie.
    Strings with equal digests are compared byte by byte. How far their occurrences all agree to the left and to the right of the anchor is
    where the repeat ends: beyond it they are diverse. Strings of the same occurrences thus tell the same repeat, which is given once.
    """
    none = (np.zeros(0, np.int64),) * 4
    order = np.lexsort((row, x))
    row, delta, x = row[order].astype(np.int32), delta[order].astype(np.int16), x[order]
    del order
    other = np.concatenate(([True], (x[1:] != x[:-1]) | (row[1:] != row[:-1]))) if len(x) else np.zeros(0, bool)
    row, delta, x = row[other], delta[other], x[other]  # a row has a string from either side: it counts once
    if len(x) < 2:
        return none
    before, after = _square(befores, REACH), _square(afters, LENGTH)
    for _ in range(2):  # those that meet in the first pass, and of them those that are equal indeed
        new = np.concatenate(([True], x[1:] != x[:-1]))
        group = np.cumsum(new, dtype=np.int32) - 1
        several = (np.bincount(group) > 1)[group]
        row, delta, x = row[several], delta[several], x[several]
        if not len(x):
            return none
        begins = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        sizes = np.diff(np.append(begins, len(x)))
        first = np.repeat(row[begins], sizes)
        del new, group, several
        left, right = _shared(*before, row, first), _shared(*after, row, first)
        equal = (left >= delta) & (right >= LENGTH - delta)
        if equal.all():
            break
        row, delta, x = row[equal], delta[equal], x[equal]
    # of rows that all agree with the first one, the least agreement is that of any two
    left, right = np.minimum.reduceat(left, begins), np.minimum.reduceat(right, begins)
    of = np.repeat(np.arange(len(begins), dtype=np.int32), sizes)
    if not complete:
        hit = farthest_of(row, left[of], right[of])
        row, of = row[hit], of[hit]
        use, of = np.unique(of, return_inverse=True)
        begins, left, right, chosen = begins[use], left[use], right[use], first[begins[use]]
    else:
        chosen = first[begins]
    strings = b"".join(befores[k][:a][::-1] + afters[k][:b] for k, a, b in zip(chosen.tolist(), left.tolist(), right.tolist(), strict=True))
    data, ends = np.frombuffer(strings, np.uint8), np.cumsum(left.astype(np.int64) + right)
    starts = ends - left - right
    name = mix(range_hashes(data, starts, ends) + left.astype(np.uint64))
    if complete:
        _, use = np.unique(name, return_index=True)
        keep = np.zeros(len(begins), bool)
        keep[use] = True
        for k in range(0, len(begins), 4096):
            keep[k : k + 4096] &= _anchored(data, starts[k : k + 4096], ends[k : k + 4096], left[k : k + 4096].astype(np.int64))
        row, of = row[keep[of]], of[keep[of]]
    return row, name.view(np.int64)[of], left[of], right[of]


def _within(rows: DataFrame, twins: bool) -> DataFrame:
    """(group, gram, context, left, right): the maximal repeats of rows whose grams lie in one task each. With twins a context that
    occurs several times counts as two rows, so it repeats even what no other context has."""

    def matched(some: pa.Table) -> pa.RecordBatch:
        own = np.arange(some.num_rows)
        if twins:
            own = np.concatenate((own, np.flatnonzero(some["times"].to_numpy() > 1)))
            own.sort()
            some = some.take(pa.array(own))
        parts: list[list[tuple]] = [[] for _ in range(PARTS if some.num_rows > WHOLE else 1)]
        for side in ("after", "before"):
            order = np.lexsort((np.array(some[side].to_pylist(), object), some["gram"].to_numpy())).astype(np.int32)
            ordered = some.take(pa.array(order))
            for r, d, x, _ in _key_strings(ordered, _depths(ordered, side, [], []), side):
                of = x % np.uint64(len(parts))
                for k, part in enumerate(parts):
                    use = slice(None) if len(parts) == 1 else of == k
                    part.append((order[r[use]], d[use].astype(np.uint8), x[use]))
            del ordered
        befores, afters = some["before"].to_pylist(), some["after"].to_pylist()
        found = []
        while parts:
            part = parts.pop()
            columns = [np.concatenate(c) for c in zip(*part, strict=True)] if part else [np.zeros(0, np.int64)] * 3
            del part
            found.append(maximal_groups(befores, afters, *columns, twins))
        row, group, left, right = (np.concatenate(c) for c in zip(*found, strict=True))
        if twins and len(found) > 1:
            _, use = np.unique(np.stack((row, group)), axis=1, return_index=True)
            row, group, left, right = row[use], group[use], left[use], right[use]
        elif len(found) > 1:
            use = farthest_of(row, left, right)
            row, group, left, right = row[use], group[use], left[use], right[use]
        if twins and len(row):  # a row and its twin are one
            _, first = np.unique(np.stack((own[row], group)), axis=1, return_index=True)
            row, group, left, right = row[first], group[first], left[first], right[first]
        at = pa.array(row)
        columns = [pa.array(group), some["gram"].combine_chunks().take(at), some["context"].combine_chunks().take(at), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["group", "gram", "context", "left", "right"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in in_parts(batches, TOGETHER):
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < TOGETHER:
                continue
            every = pa.Table.from_batches(held).combine_chunks()
            grams = every["gram"].to_numpy()
            whole = int(np.searchsorted(grams, grams[-1]))  # the last gram may go on in the next batch
            if whole:
                yield matched(every.slice(0, whole))
            held = every.slice(whole).to_batches()
        if held:
            yield matched(pa.Table.from_batches(held).combine_chunks())

    dealt = rows.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(lean(run), "group long, gram long, context long, left int, right int")


def _across(rows: DataFrame, side: str, twins: bool = False) -> DataFrame:
    """(gram, context, delta, x, y): strings of rows of very common grams, dealt over partitions by range. An interval that reaches over
    the edge of a partition is known on both sides by the stacks that scans from either side leave there. No two rows have equal keys of
    the range, so that it splits those of one string, and partitions grow in number rather than in size.

    With twins a context that occurs several times hangs in an interval of its own, as deep as it goes, and a string counts only if its anchor is
    the least gram in it, so that all its occurrences have that anchor."""
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    key = ["gram", side, "context"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // IN_PART))
    dealt = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()).checkpoint()
    reaching = _reaching(_edges(dealt, side))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        every = pa.Table.from_batches(some).combine_chunks()
        ahead, back = reaching[every["part"][0].as_py()]
        depths = _depths(every, side, list(ahead), list(back))
        if twins:
            own = [len(s.as_py()) for s in every[side]]
            depths = [(a, [*b, n]) if t > 1 else (a, b) for (a, b), n, t in zip(depths, own, every["times"].to_pylist(), strict=True)]
        for row, delta, x, y in _key_strings(every, depths, side, anchored=twins):
            at = pa.array(row)
            columns = [every["gram"].combine_chunks().take(at), every["context"].combine_chunks().take(at), pa.array(delta.astype(np.int32)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "context", "delta", "x", "y"])

    return dealt.mapInArrow(run, "gram long, context long, delta int, x long, y long")


#: Another value for each byte, for a second digest that is independent of the first.
_OTHER = np.random.default_rng(7).permutation(256).astype(np.uint8)


def repeats_of(docs: DataFrame, hot: int = HOT, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """The anchors (doc, text_hash, pos, gram, context) of docs (doc, text_hash, bytes), and the repeats (group, gram, context, times, left, right): each
    context, of so many anchors, that a group's string runs through, from left bytes before the anchor to right bytes after it.

    A context that occurs several times is a group of its own, with all that the texts have of it. Contexts of a gram none of which occurs
    once are compared with each other only if every: what they share lies within what each of them repeats. Without it a context is told of the two
    groups that go farthest, to the left and to the right.
    """
    anchored = kept(_anchor_rows(docs))
    grams = kept(anchored.groupBy("gram").count().where("count > 1").select("gram"))
    found = kept(likely_in(anchored, ["gram"], grams)[0])
    key = ["gram", "context"]
    contexts = kept(found.groupBy(*key).agg(F.count("*").alias("times"), F.min(F.struct("doc", "text_hash", "pos", "before", "after")).alias("at")))
    several = contexts.groupBy("gram").agg(F.count("*").alias("n"), F.min("times").alias("rarest")).where("n > 1")
    several = kept((several if every else several.where("rarest = 1")).select("gram", "n"))
    n_contexts = contexts.count()

    def rows_of(some: DataFrame) -> DataFrame:
        wanted = join_groups(contexts, some, ["gram"], "n", n_contexts).groupBy("at.doc", "at.text_hash").agg(F.collect_list(F.struct(F.col("at.pos").alias("pos"), "gram", "context", "times")).alias("wanted"))
        wanted = kept(wanted)
        likely, _ = likely_in(docs, ["doc", "text_hash"], wanted)
        return _contexts(likely.join(wanted, ["doc", "text_hash"]).select("bytes", "wanted"))

    groups = _within(rows_of(several.where(F.col("n") <= hot)), twins=every)
    common = several.where(F.col("n") > hot)
    if common.limit(1).count():
        rows = kept(rows_of(common) if every else rows_of(common).drop("times"))
        strings = kept(_across(rows, "after", every).unionByName(_across(rows, "before", every)).distinct())
        counted = strings.join(rows.select("gram", "context", "times"), ["gram", "context"]) if every else strings.withColumn("times", F.lit(1))
        again = kept(counted.groupBy("x", "y").agg(F.sum("times").alias("n")).where("n > 1"))
        met = join_groups(strings, again, ["x", "y"], "n", strings.count())
        groups = groups.unionByName(met.select(F.col("x").alias("group"), *key, F.col("delta").alias("left"), (LENGTH - F.col("delta")).alias("right")))
    groups = kept(groups)
    leaves = contexts.where(F.col("times") > 1)
    if every:  # the others have met theirs by their twins
        leaves = leaves.join(several.select("gram"), "gram", "left_anti")
    leaves = leaves.select(F.xxhash64(*key).alias("group"), *key, "times", F.col("at.before").cast("int").alias("left"), F.col("at.after").cast("int").alias("right"))
    # a context is in a bounded number of groups, so neither side of this join has a heavy key
    inner = groups.join(contexts.select(*key, "times"), key).select("group", *key, "times", "left", "right")
    return found.select("doc", "text_hash", "pos", *key), kept(leaves.where(F.col("left") + F.col("right") >= LENGTH).unionByName(inner))


#: Bytes beyond a repeat that are compared at first, how much more each time, and the most.
FIRST_CHUNK, CHUNK_GROWS, MOST_CHUNK = 1024, 8, 1 << 20


def _chunks(wanted: DataFrame, size: int) -> DataFrame:
    """(group, side, chunk) of (bytes, wanted: array of group, start, left, right): for each side of an occurrence that is still looked at
    (-1 if not), the bytes beyond what is known to be shared before and from its start, size at most; those to the left are backwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in range(0, len(own), 1000):
                    some = own[k : k + 1000]
                    left = [(w["group"], False, text[max(0, w["start"] - w["left"] - size) : w["start"] - w["left"]][::-1]) for w in some if w["left"] >= 0]
                    right = [(w["group"], True, text[w["start"] + w["right"] : w["start"] + w["right"] + size]) for w in some if w["right"] >= 0]
                    rows = left + right
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.binary()))], names=["group", "side", "chunk"])

    return wanted.mapInArrow(run, "group long, side boolean, chunk binary")


def _common(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The length of the common prefix of two strings each."""
    for one, two in batches:
        yield pa.array([next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) if a != b else len(a) for a, b in zip(one.to_pylist(), two.to_pylist(), strict=True)], pa.int64())


def extended(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(group, length, doc, start): the repeats found (group, doc, text_hash, start, stop) as far as all occurrences of each agree to the left and to
    the right in the texts of docs (doc, text_hash, bytes), each of them once.

    What all agree on is what the least and the greatest of the strings beyond them share, so a group's strings are pre-aggregated and never meet. Rounds
    look at ever longer strings, only for the sides of groups that agreed on all before; what is added is compared byte by byte, and so is the
    repeat itself. Repeats of the same occurrences, one for each anchor in it, become the same one: they have the same first
    occurrence and length.
    """
    _common.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    common = F.arrow_udf(_common, "long")
    sizes = kept(found.groupBy("group").agg(F.count("*").alias("n"), F.first(F.col("stop") - F.col("start")).alias("length")))
    rows = found.count()
    known = sizes.select("group", "n", "length", *[F.lit(0).cast("long").alias(c) for c in ("left", "right")], *[F.lit(True).alias(f"more_{c}") for c in ("left", "right")])
    size = FIRST_CHUNK
    done = None
    while True:
        # the right side begins at the repeat's own start, so the repeat is compared, too
        asked = join_groups(found, known, ["group"], "n", rows)
        looked = [F.when(F.col(f"more_{c}"), F.col(c)).otherwise(-1).alias(c) for c in ("left", "right")]
        wanted = kept(asked.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("group", "start", *looked)).alias("wanted")))
        likely, _ = likely_in(docs, ["doc", "text_hash"], wanted)
        chunks = _chunks(likely.join(wanted, ["doc", "text_hash"]).select("bytes", "wanted"), size)
        ends = chunks.groupBy("group", "side").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).select("group", "side", common("a", "b").alias("shared"))
        told = ends.groupBy("group").agg(F.max(F.when(~F.col("side"), F.col("shared"))).alias("l"), F.max(F.when(F.col("side"), F.col("shared"))).alias("r"))
        after = kept(
            known.join(told, "group").select(
                "group", "n", "length",
                (F.col("left") + F.coalesce("l", F.lit(0))).alias("left"), (F.col("right") + F.coalesce("r", F.lit(0))).alias("right"),
                F.coalesce(F.col("l") == size, F.lit(False)).alias("more_left"), F.coalesce(F.col("r") == size, F.lit(False)).alias("more_right"),
            )
        )
        ended = after.where("NOT more_left AND NOT more_right")
        done = ended if done is None else done.unionByName(ended)
        known = after.where("more_left OR more_right")
        if not known.limit(1).count():
            break
        size = min(size * CHUNK_GROWS, MOST_CHUNK)
    done = kept(done.where("right >= length"))  # below that two strings had one digest
    whole = join_groups(found, done, ["group"], "n", rows).select("group", (F.col("left") + F.col("right")).alias("size"), "doc", "text_hash", (F.col("start") - F.col("left")).alias("start"), "n")
    named = kept(whole.groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct("doc", "text_hash", "start")).alias("first"), F.first("size").alias("length")))
    name = F.xxhash64("first.doc", "first.text_hash", "first.start", "length")
    # of the groups that are the same repeat the occurrences of one are taken
    one = named.select(name.alias("name"), "length", "n", "group").groupBy("name", "length").agg(F.min(F.struct("group", "n")).alias("g"))
    chosen = kept(one.select("name", "length", "g.group", "g.n"))
    return join_groups(whole.drop("n", "size"), chosen, ["group"], "n", rows).select(F.col("name").alias("group"), "length", "doc", "start")


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(group, length, id, start): repeats of LENGTH bytes or more, in UTF-8, of any length, each with all its occurrences: no byte more to the left or to
    the right is the same in all of them.

    There is one for each string of LENGTH bytes at which the tree of right or of left contexts branches, if its anchor is the least gram of
    some LENGTH bytes of it, as far as its occurrences agree; the same for grams of more than hot contexts, which are dealt over tasks. So a repeat is told unless
    each such string in it occurs elsewhere, too; then longer lists of shorter repeats tell it. A null text or id takes no part; repeated rows count as one.
    """
    own = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("bytes"))
    own = own.where(F.length("bytes") >= LENGTH).select("doc", F.hash("bytes").alias("text_hash"), "bytes")
    own = own.distinct() if own.groupBy("doc", "text_hash").count().where("count > 1").limit(1).count() else own
    found, repeats = repeats_of(own, hot, every=True)
    key = ["gram", "context"]
    sized = kept(repeats.groupBy(*key).agg(F.max("times").alias("times"), F.collect_set(F.struct("group", "left", "right")).alias("all")))
    told = join_groups(found, sized, key, "times", found.count()).withColumn("g", F.explode("all"))
    at = told.select("g.group", "doc", "text_hash", (F.col("pos") - F.col("g.left")).cast("long").alias("start"), (F.col("pos") + F.col("g.right")).cast("long").alias("stop")).distinct()
    return extended(own, kept(at)).withColumnRenamed("doc", "id").select("group", "length", "id", "start")


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc, text_hash, spans: sorted array of start and end) of docs (doc, text_hash, bytes): runs of bytes of strings that occur again.
    About an anchor these are all bytes from the farthest left to the farthest right that a repeat through it goes."""
    found, repeats = repeats_of(docs, hot)
    key = ["gram", "context"]
    told = kept(repeats.groupBy(*key).agg(F.max("times").alias("times"), F.max("left").alias("left"), F.max("right").alias("right")))
    hits = join_groups(found, told, key, "times", found.count())
    # spans of one stretch of a text are joined before those of all its stretches meet: a periodic text has a span for each of its bytes
    span = F.struct((F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end"))
    stretch = hits.groupBy("doc", "text_hash", F.floor(F.col("pos") / STRETCH).alias("stretch")).agg(F.sort_array(F.collect_set(span)).alias("spans"))
    return kept(stretch.groupBy("doc", "text_hash").agg(F.sort_array(F.flatten(F.collect_list(_joined(F.col("spans"))))).alias("spans")))


def _joined(spans: Column) -> Column:
    """Sorted spans joined where they meet."""

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), longer)).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), step)


def merged(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Spans joined where they meet, cut at the text's end; a span of fewer than LENGTH bytes holds no string and goes."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        begin, end = s["start"], min(s["end"], size)
        if end - begin < LENGTH:
            continue
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.struct([pa.field("removed", pa.list_(pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())]))), pa.field("kept_bytes", pa.binary()), pa.field("sha", pa.string())])

    def of(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            runs, parts, at = merged(own, len(text)), [], 0
            for begin, end in runs:
                parts.append(text[at:begin])
                at = end
            left = b"".join([*parts, text[at:]])
            out.append({"removed": [{"start": a, "end": b} for a, b in runs], "kept_bytes": left, "sha": hashlib.sha256(left).hexdigest()})
        return pa.array(out, kind)

    return by_parts(of, batches, kind)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """docs with removed (array of start and end in UTF-8 bytes: maximal runs), n_bytes, kept_bytes and kept_sha256.

    Each byte of a string of LENGTH bytes that also starts elsewhere, in any document or in the same one, is removed, on all its
    occurrences; strings are judged on the input and never cross documents. A null text is empty. Rows that are repeated repeat each
    other's strings; a row with a null id is a document like any other. Columns of docs that have the name of a result are replaced by it.
    """
    docs = docs.drop("removed", "n_bytes", "kept_bytes", "kept_sha256")
    doc, text_hash, data, told = (free_name(docs, x) for x in ("doc_", "hash_", "bytes_", "told_"))
    own = docs.withColumn(data, F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8"))
    own = own.withColumn(text_hash, F.hash(data)).withColumn(doc, F.coalesce(F.col(id_col).cast("long"), F.xxhash64(data)))
    spans = repeated_spans(own.where(F.length(data) >= LENGTH).select(F.col(doc).alias("doc"), F.col(text_hash).alias("text_hash"), F.col(data).alias("bytes")), hot)
    spans = spans.select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.col("spans").alias(told))
    _cut.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    cut = F.arrow_udf(_cut, "struct<removed:array<struct<start:long,end:long>>,kept_bytes:binary,sha:string>")
    # a text without a repeat passes straight through; only the others are joined
    likely, rest = likely_in(own, [doc, text_hash], spans)
    joined = likely.join(spans, [doc, text_hash], "left").withColumn(told, cut(F.col(data), F.col(told)))
    r = F.col(told)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    names = ("removed", "n_bytes", "kept_bytes", "kept_sha256")
    with_spans = joined.select(*docs.columns, *(c.alias(n) for c, n in zip((r["removed"], F.length(data).cast("long"), r["kept_bytes"], r["sha"]), names, strict=True)))
    without = rest.select(*docs.columns, *(c.alias(n) for c, n in zip((none, F.length(data).cast("long"), F.col(data), F.sha2(F.col(data), 256)), names, strict=True)))
    return with_spans.unionByName(without)
