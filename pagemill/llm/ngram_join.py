"""N-gram Jaccard join by chosen paths: sets are split on sampled shared shingles until buckets are small, in several runs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import likely_in
from .cells import BLOCK, blocks_of, compare, distinct_cells, groups_of, in_pairs, met_here
from .components import connected_components
from .memory import in_parts, lean
from .shingles import intersections, mix, shingle_sets
from .tables import free_name, join_by_id, join_groups, kept

#: Jaccard similarity of a link.
THRESHOLD = 0.8
#: A bucket above this is split again; one that has been split DEPTH times is compared in blocks.
SMALL, DEPTH = 64, 3
#: Shingles that a set chooses at each split, on average.
CHOSEN = 2.0
#: The probability that a pair just at the threshold shares no bucket in any run.
MISS = 1e-4
#: Bytes of texts that are shingled at once.
SHINGLED = 1 << 19


def runs_needed(threshold: float = THRESHOLD, depth: int = DEPTH, miss: float = MISS) -> int:
    """Runs until a pair at the threshold is missed with probability miss at most.

    Of the shingles that the larger set chooses, the pair shares threshold * CHOSEN on average at least, about as a Poisson
    variable; a pair stays together at a level if one of the shared ones leads to a bucket where it stays together below.
    """
    together = 1.0
    for _ in range(depth):
        together = 1 - math.exp(-threshold * CHOSEN * together)
    return math.ceil(math.log(miss) / math.log(1 - together))


def chosen(own: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The children of nodes that a set of shingle hashes goes to: for each node the shingles whose hash under it is least, CHOSEN of them on average."""
    if not len(own):
        return np.zeros(0, np.uint64)
    value = mix(own[None] ^ mix(nodes)[:, None])
    if len(own) > CHOSEN:
        return value[value < np.uint64(int(CHOSEN / len(own) * 2**64))]
    return value.ravel()


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _sets(docs: DataFrame, runs: int) -> DataFrame:
    """(id, n, x, y, nodes): the size of each text's set, two sums that tell sets apart, and the buckets that it goes to first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, runs + 1, dtype=np.uint64))
        for batch in in_parts(batches):
            sets = shingle_sets(_texts(batch.column(1)), SHINGLED)
            x = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            y = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            nodes = [chosen(s, roots).view(np.int64) for s in sets]
            arrays = [batch.column(0), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(x), pa.array(y), pa.array(nodes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "x", "y", "nodes"])

    return docs.mapInArrow(lean(run), "id long, n long, x long, y long, nodes array<long>")


def _split(texts: DataFrame) -> DataFrame:
    """(node, key, above) one level below: texts has node, text and buckets, the (key, count) to split; above is the count of the bucket split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            sets = shingle_sets(_texts(batch.column(1)), SHINGLED)
            children = [
                [{"key": int(k), "above": b["count"]} for b in own for k in chosen(s, np.array([b["key"]], np.int64).view(np.uint64)).view(np.int64)]
                for s, own in zip(sets, batch.column(2).to_pylist(), strict=True)
            ]
            kind = pa.list_(pa.struct([pa.field("key", pa.int64()), pa.field("above", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(children, kind)], names=["node", "children"])

    split = texts.select("node", "text", "buckets").mapInArrow(lean(run), "node long, children array<struct<key:long,above:long>>")
    return split.select("node", F.explode("children").alias("c")).select("node", "c.key", "c.above")


def _buckets(docs: DataFrame, sets: DataFrame, small: int, depth: int) -> DataFrame:
    """(node, key, rank): the buckets in which nodes are to be compared; rank is the level. A large bucket is split again, but
    not below the last level, nor where it still holds most of the bucket it comes from: what hardly differs isn't split by more shingles."""
    level = sets.select("node", F.explode("nodes").alias("key")).distinct().withColumn("above", F.lit(None).cast("long"))
    leaves, texts = None, None
    for rank in range(1, depth + 1):
        sizes = level.groupBy("key").agg(F.count("*").alias("count"), F.max("above").alias("above")).where("count > 1")
        ends = F.lit(rank == depth) | (F.col("count") <= small) | F.coalesce(F.col("count") * 2 > F.col("above"), F.lit(False))
        sized = kept(level.select("node", "key").join(sizes.withColumn("ends", ends), "key"))
        here = sized.where("ends").select("node", "key", F.lit(rank).cast("long").alias("rank"))
        leaves = here if leaves is None else leaves.unionByName(here)
        large = sized.where("NOT ends")
        if rank == depth or not large.limit(1).count():
            break
        large = large.groupBy("node").agg(F.collect_set(F.struct("key", "count")).alias("buckets"))
        if texts is None:
            texts = kept(docs.join(large.select(F.col("node").alias("id")), "id").select(F.col("id").alias("node"), "text"))
        level = _split(texts.join(large, "node")).distinct()
    return leaves


PACKED = "cell long, own int, blocks int, nodes array<long>, weights array<long>, cells array<array<long>>, shingles binary, dense boolean, members binary"


def _packed(dealt: DataFrame) -> DataFrame:
    """One row for each block of dealt (cell, own, blocks, node, weight, cells, text): its distinct shingles, and which of them each node has, as bits
    or as places, whichever is less. Near copies share most of theirs, so a block is small, and it is shingled once however many others it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, ("cell", "own")):
            sets = shingle_sets(_texts(rows["text"].combine_chunks()), SHINGLED)
            shingles, place = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            dense = len(sets) * len(shingles) // 8 < 4 * len(place)
            if dense:
                bits = np.zeros((len(sets), -(-len(shingles) // 8)), np.uint8)
                np.bitwise_or.at(bits, (owner, place >> 3), (128 >> (place & 7)).astype(np.uint8))
                members = bits.tobytes()
            else:
                members = np.concatenate(([len(x) for x in sets], place)).astype(np.int32).tobytes()
            first = rows.slice(0, 1)
            columns = [first["cell"].combine_chunks(), first["own"].combine_chunks(), first["blocks"].combine_chunks()]
            columns += [pa.array([rows[c].to_pylist()]) for c in ("node", "weight")] + [pa.array([rows["cells"].to_pylist()], pa.list_(pa.list_(pa.int64())))]
            columns += [pa.array([shingles.tobytes()], pa.binary()), pa.array([dense]), pa.array([members], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "own", "blocks", "nodes", "weights", "cells", "shingles", "dense", "members"])

    columns = dealt.select("cell", "own", "blocks", "node", "weight", "cells", "text")
    return columns.repartition("cell", "own").sortWithinPartitions("cell", "own").mapInArrow(lean(run), PACKED)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's shingles, and the node and the place of each member."""
    shingles = np.frombuffer(row["shingles"], np.uint64)
    n = len(row["nodes"])
    if row["dense"]:
        owner, place = np.nonzero(np.unpackbits(np.frombuffer(row["members"], np.uint8).reshape(n, -1), axis=1, count=len(shingles)))
        return shingles, owner, place
    members = np.frombuffer(row["members"], np.int32)
    return shingles, np.repeat(np.arange(n), members[:n]), members[n:]


def _overlaps(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], n: int, m: int, width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of n sets with m others, some shared shingles at a time."""
    _, ours, theirs = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    total = np.zeros((n, m))
    for begin in range(0, len(ours), width):
        sides = []
        for (shingles, owner, place), common, size in ((one, ours, n), (two, theirs, m)):
            column = np.full(len(shingles), -1)
            column[common[begin : begin + width]] = np.arange(len(common[begin : begin + width]))
            use = column[place] >= 0
            inside = np.zeros((size, min(width, len(ours) - begin)), np.float32)
            inside[owner[use], column[place[use]]] = 1
            sides.append(inside)
        total += sides[0] @ sides[1].T
    return total


def _compared(pairs: DataFrame, threshold: float) -> DataFrame:
    """(node, links, joined) of packed blocks, each two of them (or one with itself) in one task: what cells.compare gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, ("cell", "i", "j")):
            blocks = sorted(rows.to_pylist(), key=lambda r: r["own"])
            same = blocks[0]["i"] == blocks[0]["j"]
            if not same and len(blocks) < 2:
                continue  # no node is dealt to the other block
            unpacked = [_unpacked(r) for r in blocks]
            sizes = [np.bincount(owner, minlength=len(r["nodes"])) for (_, owner, _), r in zip(unpacked, blocks, strict=True)]
            node, weight = (np.concatenate([np.array(r[c]) for r in blocks]) for c in ("nodes", "weights"))
            n = len(blocks[0]["nodes"])
            a, b = np.arange(n), np.arange(n) if same else np.arange(n, len(node))
            both = _overlaps(unpacked[0], unpacked[-1], n, len(b))
            links = both / (sizes[0][:, None] + sizes[-1][None] - both) >= threshold
            found = met_here(links, a, b, same, [c for r in blocks for c in r["cells"]], blocks[0]["cell"], node, weight)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "links", "joined"])

    return pairs.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(lean(run), "node long, links long, joined long")


def near_texts(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, depth: int = DEPTH, miss: float = MISS) -> DataFrame:
    """docs with class_id, n_links and n_shingles: a link is a pair of documents whose sets of five-word shingles have Jaccard
    similarity >= threshold, verified exactly; class_id is the smallest id that links reach.

    Words are runs of characters other than ASCII white space, as they are written. A text of one to four words is one shingle; a null
    text, or one without words, links with nothing. Equal sets are compared once and count as links of one another. A pair at the
    threshold is found with probability 1 - miss at least, nearer ones with more. Large buckets that can't be split are compared
    in blocks, each block packed once, and pairs are never listed, so no row, partner or bucket is dropped. Rows that share an id are one document (the
    greatest text of them) and get the same result; a row with a null id has no links and a null class. Columns of docs
    that have the name of a result are replaced by it.
    """
    docs = docs.drop("class_id", "n_links", "n_shingles")
    result, key = free_name(docs, "result_"), free_name(docs, "id_")
    told = near_classes(docs, threshold, id_col, text_col, small, depth, miss)
    found = told.select(F.col("id").alias(key), F.struct("class_id", "n_links", "n_shingles").alias(result))
    joined = join_by_id(docs, found, id_col, key, result)
    r = F.col(result)
    return joined.select(
        *docs.columns, F.coalesce(r["class_id"], F.col(id_col).cast("long")).alias("class_id"), F.coalesce(r["n_links"], F.lit(0)).alias("n_links"), F.coalesce(r["n_shingles"], F.lit(0)).alias("n_shingles")
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of docs that stay: of each class of near_texts those of its smallest id, and those without an id. Only rows that a Bloom filter of the
    dropped ids lets pass are shuffled."""
    gone = kept(near_classes(docs, id_col=id_col, text_col=text_col, **more).where("id <> class_id").select("id"))
    key = free_name(docs, "id_")
    likely, rest = likely_in(docs.where(F.col(id_col).isNotNull()).withColumn(key, F.col(id_col).cast("long")), [key], gone.withColumnRenamed("id", key))
    stays = likely.join(gone.withColumnRenamed("id", key), key, "left_anti").unionByName(rest).select(*docs.columns)
    return stays.unionByName(docs.where(F.col(id_col).isNull()))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, depth: int = DEPTH, miss: float = MISS) -> DataFrame:
    """(id, class_id, n_links, n_shingles) of the ids of docs, as near_texts has it; other columns take no part in any shuffle."""
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    every = kept(_sets(own, runs_needed(threshold, depth, miss)))
    again = every.groupBy("id").count().where("count > 1")
    if again.limit(1).count():  # ids that come more than once: the greatest text of each
        twice = own.join(again, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
        own = kept(own.join(again, "id", "left_anti").unionByName(twice))
        every = kept(_sets(own, runs_needed(threshold, depth, miss)))
    classes = kept(every.where("n > 0").groupBy("n", "x", "y").agg(F.min("id").alias("node"), F.count("*").alias("weight")))
    rows, key = every.count(), ["n", "x", "y"]
    full = join_groups(every.where("n > 0").select("id", *key), classes, key, "weight", rows).select("id", "node", "weight", "n")
    of = kept(full.unionByName(every.where("n = 0").select("id", F.col("id").alias("node"), F.lit(1).cast("long").alias("weight"), "n")))
    nodes = of.where("id = node")
    first = every.select("id", "nodes").join(nodes.where("n > 0").select("id"), "id").select(F.col("id").alias("node"), "nodes")
    members = distinct_cells(_buckets(own, first, small, depth))
    weights = nodes.select("node", "weight")

    def linked(rows: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sets = shingle_sets(_texts(rows["text"].combine_chunks()), SHINGLED)
        sizes = np.array([len(s) for s in sets], np.float64)
        both = intersections(sets, a, b)
        return both / (sizes[a][:, None] + sizes[b][None] - both) >= threshold

    # a node counts a link in the first cell that it shares, so all of its cells go with it into either kind of comparison
    dealt = kept(blocks_of(members))

    def with_texts(some: DataFrame) -> DataFrame:
        likely, _ = likely_in(own, ["id"], some.select(F.col("node").alias("id")).distinct())
        return some.join(weights, "node").join(likely.select(F.col("id").alias("node"), "text"), "node")

    small_cells, large = dealt.where(F.col("cell_size") <= BLOCK), dealt.where(F.col("cell_size") > BLOCK)
    met = compare(in_pairs(with_texts(small_cells)), linked, ["text"])
    if large.limit(1).count():
        met = met.unionByName(_compared(in_pairs(kept(_packed(with_texts(large)))), threshold))
    met = kept(met)
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(met.select(F.col("node").alias("a"), F.col("joined").alias("b")))
    told = kept(weights.join(counts, "node", "left").join(roots, "node", "left").select("node", "weight", "links", "component"))
    return join_groups(of.select("id", "node", "n"), told, ["node"], "weight", rows).select(
        "id", F.coalesce("component", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("n").alias("n_shingles")
    )
