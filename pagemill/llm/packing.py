"""Packing: documents in order, cut into windows at document or sentence ends by dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_path, encoder

#: What a cut costs, in tokens of padding: at a document's end, at a sentence's end, anywhere else; and each window as such.
AT_DOCUMENT, AT_SENTENCE, ELSEWHERE, WINDOW_COST = 0.0, 6.0, 96.0, 2.0
#: Where sentences are longer than this, cuts are allowed at every STRIDE-th token of them.
LONG_SENTENCE, STRIDE = 256, 64
#: Tokens that are planned at once; a partition is a run of such blocks.
BLOCK_TOKENS = 1 << 17


def padding(length: int, window: int) -> int:
    """A sequence whose length is a power of two isn't padded; any other is padded to the window."""
    return 0 if length & (length - 1) == 0 else window - length


def candidates(ends_document: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may be made (number of tokens before it) and what each costs. The last position is the end."""
    cost = np.where(ends_document, AT_DOCUMENT, np.where(ends_sentence, AT_SENTENCE, np.inf))
    places = np.concatenate(([0], np.flatnonzero(np.isfinite(cost)) + 1))
    gaps = np.diff(places)
    extra = [np.arange(places[i] + STRIDE, places[i + 1], STRIDE) for i in np.flatnonzero(gaps > LONG_SENTENCE)]
    cost = np.concatenate(([0.0], cost))
    if extra:
        extra = np.concatenate(extra)
        cost[extra] = ELSEWHERE
        places = np.union1d(places, extra)
    return places, cost[places]


def cuts(places: np.ndarray, costs: np.ndarray, window: int) -> list[int]:
    """The places to cut at, from 0 to the end, with the least padding plus penalties.

    best[j] is the least cost of the tokens before places[j]. A window from i to j costs window - (p[j] - p[i]), so the best i is
    that with the least best[i] + p[i] in reach: a queue in which that sum rises has it at its head. Windows whose
    length is a power of two aren't padded; they are looked up one by one.
    """
    at = places.tolist()
    cost = costs.tolist()
    n = len(at)
    exact: list[list[int]] = [[] for _ in range(n)]
    power = 1
    while power <= window:
        i = np.searchsorted(places, places - power)
        hits = np.flatnonzero((places >= power) & (places[np.minimum(i, n - 1)] == places - power))
        for j, k in zip(hits.tolist(), i[hits].tolist(), strict=True):
            exact[j].append(k)
        power *= 2
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[int, float]] = deque([(0, 0.0)])  # index, best + place
    for j in range(1, n):
        p = at[j]
        reach = p - window
        while at[queue[0][0]] < reach:
            queue.popleft()
        i, least = queue[0]
        least += window - p
        for k in exact[j]:
            if best[k] < least:
                i, least = k, best[k]
        least += cost[j] + WINDOW_COST
        best[j], back[j] = least, i
        least += p
        while queue and queue[-1][1] >= least:
            queue.pop()
        queue.append((j, least))
    found = [n - 1]
    while found[-1]:
        found.append(back[found[-1]])
    return [at[j] for j in reversed(found)]


class _Packer:
    """Packs one partition's documents block by block; what the last window of a block holds moves on to the next block."""

    def __init__(self, first_sequence: int, window: int, ends: np.ndarray, with_ids: bool):
        self.sequence, self.window, self.ends, self.with_ids = first_sequence, window, ends, with_ids
        self.parts: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start, ids, doc_tokens
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.parts.append((doc_id, 0, ids, len(ids)))
        self.tokens += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        if not self.parts:
            return []
        ids = np.concatenate([p[2] for p in self.parts])
        edges = np.cumsum([0] + [len(p[2]) for p in self.parts])
        ends_document = np.zeros(len(ids), dtype=bool)
        ends_document[edges[1:] - 1] = True
        at = cuts(*candidates(ends_document, self.ends[ids]), self.window)
        if not last:
            at = at[:-1]
        rows, part = [], 0
        for begin, end in zip(at[:-1], at[1:], strict=True):
            here = begin
            while here < end:
                while edges[part + 1] <= here:
                    part += 1
                stop = min(end, int(edges[part + 1]))
                doc_id, start, own, total = self.parts[part]
                piece = ids[here:stop]
                rows.append((doc_id, start + here - int(edges[part]), stop - here, zlib.crc32(piece.tobytes()), total, self.sequence, here - begin, *([piece] if self.with_ids else [])))
                here = stop
            self.sequence += 1
        left = []
        for k, (doc_id, start, own, total) in enumerate(self.parts):
            if edges[k + 1] > at[-1]:
                skip = max(0, at[-1] - int(edges[k]))
                left.append((doc_id, start + skip, own[skip:], total))
        self.parts, self.tokens = left, len(ids) - at[-1]
        return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document is its token ids and end_id; a null text is empty, and so one token. Each id lies in exactly one piece. A
    sequence holds at most window tokens, its pieces follow one another from offset 0, and documents keep the order of
    their partition. Partitions are packed where they are, without a shuffle; a retried task numbers its sequences alike. Each
    row is a document of its own, so repeated rows are packed as often as they come; a null id stays null. Memory is
    bounded by BLOCK_TOKENS and the longest text.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    fields = [pa.field(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    to = pa.schema(fields + [pa.field("ids", pa.list_(pa.int64()))] * with_ids)
    where = path

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), to, strict=True)], schema=to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = encoder(where or default_path())
        context = TaskContext.get()
        packer = _Packer((context.partitionId() if context else 0) << 33, window, ends, with_ids)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(doc_id, np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4"))
                if packer.tokens >= BLOCK_TOKENS and (rows := packer.flush(last=False)):
                    yield batch(rows)
        if rows := packer.flush(last=True):
            yield batch(rows)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
