"""Mixing sources to target weights: histograms over hash buckets find each source's threshold, without a sort of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import free_name, if_small, kept

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, again and again.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the input.
SHARE = 1.5
#: No document is taken more often than this.
MOST_REPEATS = 2
#: A place is a 60-bit hash, read 12 bits (4096 buckets) at a time.
BUCKET_BITS, LEVELS = 12, 5
#: So many sources are broadcast.
SOURCES_BROADCAST = 100_000

RESULTS = ("size", "source_size", "target", "taken")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) of (source, source_size): share of all sizes dealt by weight.

    A target stops at most times its source's size, and the excess is dealt again by weight until none is above. That ends
    where every source has the smaller of its cap and weight * level. Sources in order of cap / weight reach their caps first, so the
    level comes from running sums; it is over sources, not over rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = Window.orderBy((F.col("cap") / F.col("weight")), F.col("i"))
    before, every = rank.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    weighed = (
        sizes.withColumn("i", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
    )
    levels = weighed.withColumn(
        "level",
        (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    # the level that counts is that of the first source whose cap isn't reached; before it all are full
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("i").alias("i"), F.col("level").alias("level")))).over(every)
    return levels.withColumn("free", free).select("source", "source_size", F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("free.level") * F.col("weight"))).alias("target"))


def thresholds(placed: DataFrame, edge: DataFrame, place: str) -> DataFrame:
    """edge (source, left and more) with the place at which what is left of the budget ends, what is left there, and the words and rows of that place.

    placed: (source, place, size). Each level sums sizes by source and bucket, finds the bucket in which the running sum
    crosses what is left of the budget, and the next level looks at that bucket's rows alone. The last bucket is one place.
    """
    own = [c for c in edge.columns if c not in ("left", "prefix", "words", "rows")]
    edge = edge.select(*own, "left", F.lit(0).cast("long").alias("prefix"))
    running = Window.partitionBy("source").orderBy("bucket")
    few = edge.limit(SOURCES_BROADCAST + 1).count() <= SOURCES_BROADCAST  # an edge is one row for each source at most
    for level in range(1, LEVELS + 1):
        shift = BUCKET_BITS * (LEVELS - level)
        e, r = edge.alias("e"), placed.alias("r")
        inside = F.col("r.source").eqNullSafe(F.col("e.source")) & (F.shiftright(F.col(f"r.{place}"), shift + BUCKET_BITS) == F.col("e.prefix"))
        sums = (
            r.join(F.broadcast(e) if few else e, inside)
            .groupBy(*[F.col(f"e.{c}").alias(c) for c in (*own, "left", "prefix")], F.shiftright(F.col(f"r.{place}"), shift).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
            .withColumn("upto", F.sum("words").over(running))
        )
        crossed = sums.where("upto > left AND upto - words <= left")
        edge = crossed.select(*own, (F.col("left") - F.col("upto") + F.col("words")).alias("left"), F.col("bucket").alias("prefix"), "words", "rows")
    return edge.withColumnRenamed("prefix", place)


def _place(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, BUCKET_BITS * LEVELS // 4), 16, 10).cast("long")


def _some(rows: DataFrame, source: str, edge: str, times: Column, more: str) -> DataFrame:
    """rows, which are alike for each source, with more: true for so many of them. Each partition's share comes of counts of the partitions."""
    part, rank, before, s = (free_name(rows, x) for x in ("part_", "rank_", "before_", "s_"))
    told = kept(rows.withColumn(part, F.spark_partition_id()))
    counts = told.groupBy(F.col(source).alias(s), F.col(part).alias(rank)).agg(F.count("*").alias("n"))
    upto = counts.select(s, rank, (F.sum("n").over(Window.partitionBy(s).orderBy(rank)) - F.col("n")).alias(before))
    ranked = told.withColumn("number_", F.row_number().over(Window.partitionBy(source, part).orderBy(F.lit(1))))
    joined = ranked.join(F.broadcast(upto), F.col(source).eqNullSafe(F.col(s)) & (F.col(part) == F.col(rank)))  # a row for each source and task at most
    return joined.withColumn(more, F.col("number_") + F.col(before) <= times).drop(part, rank, before, s, "number_")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """docs with four columns more: size (words), source_size, target (its source's) and taken (words that the mix takes of it).

    A document is taken whole, zero to most times. A null text has no words; a null source is a source of its own, last in order. A
    document's place is a hash of its id (of its text where the id is null), so reruns agree and a larger target takes a superset. Rows that share
    a place have a second one by their text, and of those that share this too, being alike, as many are taken as fit. Each source's taken
    words differ from its target by half of one document at most. Where a source has no words, or nothing at all is in the table,
    nothing is taken. Columns of docs that have the name of a result are replaced by it.
    """
    docs = docs.drop(*RESULTS)
    place, second, source, edge, more = (free_name(docs, x) for x in ("place_", "second_", "source_", "edge_", "more_"))
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    sized = docs.withColumn("size", F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")).withColumn(place, _place(key))
    placed = kept(sized.select(F.col(source_col).alias("source"), F.col(place).alias("place"), "size"))
    targets = kept(source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    whole = F.floor(F.col("target") / F.col("source_size")).cast("int")
    budget = targets.withColumn("repeats", F.when(F.col("source_size") > 0, whole).otherwise(0)).withColumn("left", F.col("target") - F.col("repeats") * F.col("source_size"))
    ends = kept(thresholds(placed, budget, "place"))
    shared = bool(ends.where("rows > 1").limit(1).count())
    if shared:  # several rows in the place where a source's budget ends
        at = ends.where("rows > 1").select(F.col("source").alias("s"), F.col("place").alias("p"))
        here = sized.join(at, F.col(source_col).eqNullSafe(F.col("s")) & (F.col(place) == F.col("p"))).select(F.col(source_col).alias("source"), _place(F.coalesce(text_col, F.lit(""))).alias("second"), "size")
        seconds = thresholds(kept(here), ends.where("rows > 1").select("source", "place", "left"), "second")
        seconds = seconds.select(F.col("source").alias("s"), "second", F.col("left").alias("left2"), F.col("words").alias("words2"), F.col("rows").alias("rows2"))
        ends = kept(ends.join(seconds, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    else:
        ends = ends.withColumns({"second": F.lit(None).cast("long"), "left2": F.lit(None).cast("double"), "words2": F.lit(None).cast("long"), "rows2": F.lit(None).cast("long")})
    # a place, or a second one, of a single row is taken if that is no farther from the target; of rows that are alike so many
    times = F.floor(F.coalesce("left2", "left") / (F.coalesce("words2", "words") / F.coalesce("rows2", "rows")) + 0.5)
    last = ends.select(F.col("source").alias("s"), "repeats", "place", "second", times.alias("times"), F.coalesce("rows2", "rows").alias("rows"))
    found = targets.join(last, F.col("source").eqNullSafe(F.col("s")), "left")
    found = kept(found.select(F.col("source").alias(source), F.struct("source_size", "target", "repeats", "place", "second", "times", "rows").alias(edge)))
    if shared:
        sized = sized.withColumn(second, _place(F.coalesce(text_col, F.lit(""))))
    joined = sized.join(if_small(found, SOURCES_BROADCAST), F.col(source_col).eqNullSafe(F.col(source)))
    e = F.col(edge)
    below, here = F.col(place) < e["place"], F.col(place) == e["place"]
    if shared:
        here_too = F.col(second) == e["second"]
        below, here = below | (here & F.coalesce(F.col(second) < e["second"], F.lit(False))), here & (here_too | e["second"].isNull())
    below, here = F.coalesce(below, F.lit(False)), F.coalesce(here, F.lit(False))
    alike = here & (e["rows"] > 1)
    rows = joined.where(~alike).withColumn(more, below | here & (e["times"] >= 1))
    if shared and found.where(e["rows"] > 1).limit(1).count():
        rows = rows.unionByName(_some(joined.where(alike), source, edge, e["times"], more))
    taken = F.coalesce(F.col("size") * (e["repeats"] + F.col(more).cast("int")), F.lit(0)).cast("long")
    return rows.select(*docs.columns, "size", e["source_size"].alias("source_size"), e["target"].alias("target"), taken.alias("taken"))
