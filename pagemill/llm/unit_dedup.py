"""Substring dedup by units: lines, cut at sentence ends, are normalised and hashed; of equal units the earliest stays."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import likely_in
from .memory import by_parts, lean
from .tables import free_name, join_groups, kept

#: Units follow one another without a gap: a line, cut again after each run of sentence ends.
SENTENCES = r"[^\n.!?]*[\n.!?]+|[^\n.!?]+"
#: Whole lines, and paragraphs between empty lines.
LINES = r"[^\n]*\n|[^\n]+"
PARAGRAPHS = r"(?:[^\n]+\n?)+\n*|\n+"
#: Repeated units that follow one another are removed if they come to so many words together.
LEAST_WORDS = 20
#: Characters of scripts without spaces; two count as a word.
UNSPACED = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"

_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_UNSPACED = re.compile(UNSPACED)
_SPANS = pa.list_(pa.struct([pa.field("start", pa.int32()), pa.field("end", pa.int32())]))


def units_of(text: str, pattern: str = SENTENCES) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the text's units that aren't blank. A digest is of the unit in lower case, each white space one space."""
    for m in re.finditer(pattern, text):
        unit = _SPACE.sub(" ", m[0]).strip(" ").lower()
        if unit:
            words = unit.count(" ") + 1
            if not unit.isascii():
                words = max(words, len(_UNSPACED.findall(unit)) // 2)
            yield m.start(), m.end(), words, hashlib.blake2b(unit.encode(), digest_size=16).digest()


def _units(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc, h, pos, start, end, words, x, y): the units of docs (doc, h, text) by their ordinal in the text, x and y being the digest."""
    names = ["doc", "h", "pos", "start", "end", "words", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, units, counts = [], [], []
            held = 0
            for k in range(batch.num_rows):
                own = list(units_of(batch.column(2)[k].as_py(), pattern))
                row.append(k)
                counts.append(len(own))
                units += own
                held += len(own)
                if held < 20_000 and k + 1 < batch.num_rows:
                    continue
                of = pa.array(np.repeat(row, counts))
                pos = np.arange(held, dtype=np.int32) - np.repeat(np.cumsum(counts) - counts, counts).astype(np.int32)
                starts, ends, words, digests = zip(*units, strict=True) if units else ((), (), (), ())
                xy = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                arrays = [batch.column(0).take(of), batch.column(1).take(of), pa.array(pos), *(pa.array(c, pa.int32()) for c in (starts, ends, words)), pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                row, units, counts, held = [], [], [], 0

    return docs.mapInArrow(lean(run), "doc long, h long, pos int, start int, end int, words int, x long, y long")


def runs_of(again: pa.Array, least_words: int) -> pa.Array:
    """For each list of units in order, the spans of its runs of units whose ordinals follow one another and that have words enough."""
    units, offsets = again.flatten(), again.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    pos, start, end, words = (units.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "start", "end", "words"))
    if not len(pos):
        return pa.array([[]] * len(again), _SPANS)
    new = np.concatenate(([True], pos[1:] != pos[:-1] + 1))
    new[offsets[:-1][offsets[:-1] < len(pos)]] = True
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(pos)])) - 1
    use = np.add.reduceat(words, first) >= least_words
    first, last = first[use], last[use]
    spans = pa.StructArray.from_arrays([pa.array(start[first].astype(np.int32)), pa.array(end[last].astype(np.int32))], fields=list(_SPANS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, offsets).astype(np.int32)), spans)


def _without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    def of(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, cut in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            at, parts = 0, []
            for s in cut or ():
                parts.append(text[at : s["start"]])
                at = s["end"]
            out.append(text if not cut else "".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    return by_parts(of, batches, pa.string())


def repeated_runs(docs: DataFrame, pattern: str = SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc, h, spans: array of start and end) of docs (doc, h, text): runs of units that occur earlier, in order of doc, h and place.

    Texts are cut once. Half of each digest is counted; only units that a Bloom filter of the repeated ones lets pass are grouped and joined.
    """
    units = kept(_units(docs, pattern))
    repeated = kept(units.groupBy("x").count().where("count > 1").select("x"))
    maybe = kept(likely_in(units, ["x"], repeated)[0])
    firsts = kept(maybe.groupBy("x", "y").agg(F.min(F.struct("doc", "h", "pos")).alias("first"), F.count("*").alias("times")).where("times > 1"))
    again = join_groups(maybe, firsts, ["x", "y"], "times", maybe.count()).where(F.struct("doc", "h", "pos") != F.col("first"))

    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield runs_of(batch, least_words)

    spans.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    listed = again.groupBy("doc", "h").agg(F.sort_array(F.collect_set(F.struct("pos", "start", "end", "words"))).alias("again"))
    return kept(listed.select("doc", "h", F.arrow_udf(spans, "array<struct<start:int,end:int>>")("again").alias("spans")).where("size(spans) > 0"))


def drop_repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with removed (array of start and end, in code points of the text as it was), n_removed (characters), n_spans and text_kept.

    Units are compared over all documents and within one, however short. Of equal units the first of the smallest id stays; others
    go where those that follow one another (blank ones between them don't count) have least_words words together, so a passage of short
    lines goes as a whole, and a phrase that many documents share by chance stays. A null text stays null and has no units;
    a row with a null id stays as it is and takes no part. Rows that share an id are documents of their own if their texts
    differ, in an order of the texts' hashes, and one document if they are equal. Documents without a repeat aren't shuffled. Columns of docs that
    have the name of a result are replaced by it.
    """
    docs = docs.drop("removed", "n_removed", "n_spans", "text_kept")
    spans, key, h = free_name(docs, "spans_"), free_name(docs, "id_"), free_name(docs, "h_")
    hashed = docs.withColumns({key: F.col(id_col).cast("long"), h: F.xxhash64(F.col(text_col).cast("string"))})
    own = hashed.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(key).alias("doc"), F.col(h).alias("h"), F.col(text_col).cast("string").alias("text"))
    cut = repeated_runs(own, pattern, least_words).select(F.col("doc").alias(key), F.col("h").alias(h), F.col("spans").alias(spans))
    likely, rest = likely_in(hashed, [key, h], cut)
    none = F.array().cast("array<struct<start:int,end:int>>")
    # in the join a null id or text meets nothing
    joined = likely.join(cut, [key, h], "left").withColumn(spans, F.coalesce(spans, none)).unionByName(rest.withColumn(spans, none))
    _without.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return joined.select(
        *docs.columns,
        F.col(spans).alias("removed"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.arrow_udf(_without, "string")(F.col(text_col).cast("string"), F.col(spans)).alias("text_kept"),
    )
