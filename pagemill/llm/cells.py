"""Cells: small sets of rows that are compared with one another in one task, and large ones block by block.

A node that lies in several cells meets another in the first cell that both share; only there is their link counted. So no pair
of rows is ever emitted: what comes out is a row or two for each node and block, with counts and the smallest node that it is joined to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import kept

#: A cell above this is cut into blocks of about so many nodes, and each two blocks meet in a task.
BLOCK = 256


def distinct_cells(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, cell, cell_size) of members (key, rank, node): cells of one node are dropped, and of cells that hold the same
    nodes one is kept. Large cells that are much the same are made one, so a large group isn't compared again and again."""
    cells = (
        members.groupBy("key", "rank")
        .agg(F.count("*").alias("cell_size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
        .where("cell_size > 1")
        .groupBy("cell_size", "x", "y")
        .agg(F.min(F.struct("rank", "key")).alias("first"))
        .select("first.key", "first.rank", "cell_size", F.monotonically_increasing_id().alias("cell"))
    )
    inside = kept(members.join(kept(cells), ["key", "rank"]).select("node", "cell", "cell_size"))
    large = inside.where(F.col("cell_size") > block)
    if not large.limit(1).count():
        return inside
    # a large cell goes into the first cell of most of its nodes
    first = large.groupBy("node").agg(F.min("cell").alias("first"))
    most = large.join(first, "node").where("cell <> first").groupBy("cell", "cell_size", "first").count().where("2 * count >= cell_size")
    into = connected_components(most.select(F.col("cell").alias("a"), F.col("first").alias("b"))).select(F.col("node").alias("cell"), "component")
    joined = kept(large.join(into, "cell", "left").select("node", F.coalesce("component", "cell").alias("cell")).distinct())
    sizes = joined.groupBy("cell").agg(F.count("*").alias("cell_size"))
    return kept(inside.where(F.col("cell_size") <= block).unionByName(joined.join(sizes, "cell").select("node", "cell", "cell_size")))


def blocks_of(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, cells, cell, cell_size, blocks, own): the block of its cell that each member is in; cells are all of a node's."""
    dealt = members.withColumn("blocks", F.ceil(F.col("cell_size") / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = members.groupBy("node").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    return dealt.join(cells, "node").select("node", "cells", "cell", "cell_size", "blocks", "own")


def in_pairs(dealt: DataFrame) -> DataFrame:
    """dealt (blocks, own, ...) once for each block that its own one meets, in a task for each pair of blocks i and j."""
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")


def in_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, cells, cell, i, j, own): members dealt to the tasks where they are compared."""
    return in_pairs(blocks_of(members, block)).select("node", "cells", "cell", "i", "j", "own")


def groups_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, over the ends of batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        columns = np.stack([rows[k].to_numpy().astype(np.int64) for k in keys])
        if held and (columns[:, 0] != last).any():
            yield pa.concat_tables(held).combine_chunks()
            held = []
        starts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), rows.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if held and a:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(rows.slice(a, b - a))
        last = columns[:, -1]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _first_meeting(cells: list[list[int]], here: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the nodes of a and those of b share no cell before here."""
    number: dict[int, int] = {}
    row, column = [], []
    for k, own in enumerate(cells):
        for cell in own:
            if cell >= here:
                break
            row.append(k)
            column.append(number.setdefault(cell, len(number)))
    column = np.array(column, dtype=np.int64)
    shared = np.bincount(column, minlength=len(number)) > 1 if len(column) else np.zeros(0, bool)
    if not shared.any():
        return np.ones((len(a), len(b)), bool)
    place = np.cumsum(shared) - 1
    inside = np.zeros((len(cells), int(shared.sum())), np.float32)
    use = shared[column]
    inside[np.array(row)[use], place[column[use]]] = 1
    return inside[a] @ inside[b].T == 0


def met_here(links: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool, cells: list[list[int]], here: int, node: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, joined) of the nodes with a link, where links tells which of a and of b have one; same: both are one block."""
    if same:
        np.fill_diagonal(links, False)
    count, joined = np.zeros(len(node), np.int64), node.copy()
    if links.any():
        counted = links & _first_meeting(cells, here, a, b)
        count[a] += counted @ weight[b]
        if not same:
            count[b] += weight[a] @ counted
        most = np.iinfo(np.int64).max
        while True:
            before = joined.copy()
            joined[a] = np.minimum(joined[a], np.where(links, joined[b][None], most).min(axis=1))
            joined[b] = np.minimum(joined[b], np.where(links, joined[a][:, None], most).min(axis=0))
            if (joined == before).all():
                break
    told = (joined != node) | (count > 0)
    return node[told], count[told], joined[told]


def compare(blocks: DataFrame, linked: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray], payload: list[str], partitions: int | None = None) -> DataFrame:
    """(node, links, joined) of blocks with a weight column and payload columns: the weights of a node's links that are first met
    in this cell, and the smallest node that it is joined to there.

    linked(rows, a, b) tells which rows of a and b are linked; it is asked once for each block, and never of a cell's whole.
    """
    keys = ("cell", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows_out = 0
        for rows in groups_of(batches, keys):
            i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
            own = rows["own"].to_numpy()
            a = np.flatnonzero(own == i)
            b = a if i == j else np.flatnonzero(own == j)
            if not len(a) or not len(b) or rows.num_rows < 2:
                continue
            links = linked(rows, a, b)
            found = met_here(links, a, b, i == j, rows["cells"].to_pylist(), rows["cell"][0].as_py(), rows["node"].to_numpy(), rows["weight"].to_numpy())
            out.append(found)
            rows_out += len(found[0])
            if rows_out > 20_000:
                yield pa.RecordBatch.from_arrays([np.concatenate(x) for x in zip(*out, strict=True)], names=["node", "links", "joined"])
                out, rows_out = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([np.concatenate(x) for x in zip(*out, strict=True)], names=["node", "links", "joined"])

    dealt = blocks.select(*keys, "own", "node", "weight", "cells", *payload)
    dealt = dealt.repartition(partitions, *keys) if partitions else dealt.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, "node long, links long, joined long")
