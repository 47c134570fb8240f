"""Exact dedup: two passes over a Bloom filter, then a shuffle of the possibly repeated rows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import BLOCK_BITS, BROADCAST_BYTES, bit, blocks_for, likely_in
from .tables import free_name, join_groups, kept

RESULTS = ("keep_id", "group_size", "kept", "text_sha256")
#: With fewer filter bits for each row than this, most bits would be set twice by chance.
LEAST_BITS_A_ROW = 2


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with four columns more: keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical; a null text counts as empty. Of equal texts the row with the largest id stays;
    keep_id is its id. A null id is less than any other. Of several equal texts that share the largest id, one row stays.
    An empty table gives an empty table. Columns of docs that have the name of a result are replaced by it.

    Pass one sets each row's two bits in one block of a Bloom filter and keeps the bits that two rows or more have set; it shuffles two pairs of
    numbers (block and bit) for each row, partly counted before, and no text. Pass two
    probes each row: only rows whose bits were both set again can have an equal, and only those are shuffled by their
    digest; the others pass straight through. The filter is broadcast, broadcast_bytes at most. Where that leaves fewer than
    LEAST_BITS_A_ROW bits a row, pass one counts eight bytes of each digest in a shuffle of those alone, and the filter
    holds the counted repeats: texts that don't repeat aren't shuffled at any size. Groups are pre-aggregated, and rows of heavy ones stay where they are.
    """
    docs = docs.drop(*RESULTS)
    sha, short, block, first, second, uid, best = (free_name(docs, x) for x in ("text_sha256", "short_", "block_", "first_", "second_", "uid_", "best_"))
    rows = docs.count()
    blocks = blocks_for(rows, broadcast_bytes)
    hashed = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    out = docs.columns
    if blocks * BLOCK_BITS >= rows * LEAST_BITS_A_ROW:
        places = hashed.withColumns(
            {
                block: F.pmod(F.xxhash64(sha), F.lit(blocks)).cast("long"),
                first: F.conv(F.substring(sha, 1, 4), 16, 10).cast("long") % BLOCK_BITS,
                second: F.conv(F.substring(sha, 5, 4), 16, 10).cast("long") % BLOCK_BITS,
            }
        )
        again = (
            places.select(block, F.explode(F.array_distinct(F.array(first, second))).alias(first))
            .groupBy(block, first)
            .count()
            .where("count > 1")
            .groupBy(block)
            .agg(F.bitmap_construct_agg(first).alias(best))
        )
        probed = places.join(F.broadcast(again), block, "left").withColumn(best, F.coalesce(bit(F.col(best), F.col(first)) & bit(F.col(best), F.col(second)), F.lit(False)))
        likely, unique = probed.where(best).select(*out, sha), probed.where(~F.col(best)).select(*out, sha)
    else:
        counted = hashed.withColumn(short, F.xxhash64(sha))
        again = kept(counted.groupBy(short).count().where("count > 1").select(short))
        likely, unique = (part.drop(short) for part in likely_in(counted, [short], again, broadcast_bytes))
    single = unique.select(*out, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col(sha).alias("text_sha256"))
    maybe = kept(likely.withColumn(uid, F.monotonically_increasing_id()))
    groups = kept(maybe.groupBy(sha).agg(F.max(F.struct(F.col(id_col).alias("id"), F.col(uid).alias("uid"))).alias(best), F.count("*").alias("group_size")))
    repeated = join_groups(maybe, groups, [sha], "group_size", rows).select(
        *out, F.col(f"{best}.id").alias("keep_id"), "group_size", (F.col(uid) == F.col(f"{best}.uid")).alias("kept"), F.col(sha).alias("text_sha256")
    )
    return single.unionByName(repeated)
