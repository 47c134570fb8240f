"""Embedding near-dedup: sign hashing by random hyperplanes in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import compare, distinct_cells, in_blocks
from .components import connected_components
from .tables import free_name, join_by_id, join_groups, kept

#: The probability that a pair just at the threshold shares no table.
MISS = 1e-4


def shape(rows: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a signature and number of tables: buckets of about one unrelated row, and tables until a pair is missed with probability miss."""
    bits = min(62, max(8, math.ceil(math.log2(max(rows, 2)))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - together))


def _signatures(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    planes = np.random.default_rng(vectors.shape[1]).normal(size=(vectors.shape[1], bits * tables))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _hashed(df: DataFrame, bits: int, tables: int, label_type: str) -> DataFrame:
    """(id, label, embedding, dim, signatures) of (id, label, embedding), without vectors that are zero or hold a null or non-finite component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
            for dim in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == dim)
                flat = vectors.take(pa.array(at)).flatten()
                values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                with np.errstate(over="ignore"):
                    good = np.isfinite(values).all(axis=1) & values.any(axis=1)
                if not good.any():
                    continue
                scaled = values[good] / np.abs(values[good]).max(axis=1, keepdims=True)
                rows = batch.take(pa.array(at[good]))
                signs = _signatures(scaled, bits, tables)
                arrays = [*rows.columns, pa.array(np.full(len(signs), dim, np.int64)), pa.array(list(signs), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "label", "embedding", "dim", "signatures"])

    kind = df.schema["embedding"].dataType.simpleString()
    return df.mapInArrow(run, f"id long, label {label_type}, embedding {kind}, dim long, signatures array<long>")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", miss: float = MISS) -> DataFrame:
    """vectors with n_links, component_id and kept: a link is a pair of one label with cosine >= threshold (double precision).

    Each pair at the threshold is found with probability 1 - miss at least, nearer ones with more. Nothing links with a null label or a
    vector that is null, empty, zero, of another length, or holds a null or non-finite component. Rows that share an id are one
    vector (the greatest label and vector of them) and get the same result; a row with a null id is kept, with no links and
    a null component. component_id is the smallest id reachable by links; kept says that it is the row's own. Equal vectors are
    compared once. Columns of vectors that have the name of a result are replaced by it.
    """
    vectors = vectors.drop("n_links", "component_id", "kept")
    label_type = vectors.schema[label_col].dataType.simpleString()
    one = (
        vectors.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(F.struct(F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))).alias("v"))
        .select("id", "v.label", "v.embedding")
        .where("label IS NOT NULL AND embedding IS NOT NULL")
    )
    bits, tables = shape(vectors.count(), threshold, miss)
    hashed = kept(_hashed(one, bits, tables, label_type))
    classes = kept(hashed.groupBy("label", "embedding").agg(F.min("id").alias("node"), F.count("*").alias("weight")))
    rows = hashed.count()
    of = kept(join_groups(hashed, classes.where("weight > 1"), ["label", "embedding"], "weight", rows, "left").select("id", F.coalesce("node", "id").alias("node"), F.coalesce("weight", F.lit(1)).alias("weight"), "label", "dim", "embedding", "signatures"))
    nodes = of.where("id = node")
    members = nodes.select("node", "label", "dim", F.posexplode("signatures").alias("rank", "signature")).select("node", F.struct("label", "dim", "signature").alias("key"), F.col("rank").cast("long"))
    blocks = in_blocks(distinct_cells(members)).join(nodes.select("node", "weight", "embedding"), "node")

    def linked(rows: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        flat = rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        values = flat.reshape(rows.num_rows, -1)
        values = values / np.abs(values).max(axis=1, keepdims=True)
        norm = np.sqrt((values * values).sum(axis=1))
        return (values[a] @ values[b].T) / (norm[a][:, None] * norm[b][None]) >= threshold

    met = kept(compare(blocks, linked, ["embedding"]))
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(met.select(F.col("node").alias("a"), F.col("joined").alias("b")))
    result, component = free_name(vectors, "result_"), free_name(vectors, "id_")
    told = kept(nodes.select("node", "weight").join(counts, "node", "left").join(roots, "node", "left").select("node", "weight", "links", "component"))
    found = join_groups(of.select("id", "node"), told, ["node"], "weight", rows).select(
        F.col("id").alias(component), F.struct((F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "node").alias("c")).alias(result)
    )
    joined = join_by_id(vectors, found, id_col, component, result)
    root = F.coalesce(F.col(result)["c"], F.col(id_col).cast("long"))
    return joined.select(
        *vectors.columns, F.coalesce(F.col(result)["n"], F.lit(0)).alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col(id_col), F.lit(True)).alias("kept")
    )
