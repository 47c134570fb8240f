"""Tables kept between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import kept  # noqa: F401  the operators take it from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most so many rows; beyond that Spark chooses the join itself."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until no column of df is called so (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: More groups than this can't each hold more than a MOST_HEAVY-th of all rows.
MOST_HEAVY = 2048


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows (total of them) joined with groups, which have one row a key and its number of rows in size; how: inner, or left.

    Groups that hold more than a MOST_HEAVY-th of all rows are fewer than MOST_HEAVY, so they can be broadcast, and
    their rows stay where they are; the others meet in a shuffle in which no key is heavy. Both tables are read twice, so they should be kept.
    """
    heavy = F.broadcast(groups.where(F.col(size) * MOST_HEAVY > total))
    light = groups.where(F.col(size) * MOST_HEAVY <= total)
    return rows.join(heavy, keys).unionByName(rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys, how))


def join_by_id(rows: DataFrame, found: DataFrame, id_col: str, key: str, result: str) -> DataFrame:
    """rows with the result that found (key, result) has for their id, null where it has none. Rows without an id meet nothing and aren't shuffled."""
    with_id = rows.where(F.col(id_col).isNotNull()).join(found, F.col(id_col) == F.col(key), "left").drop(key)
    return with_id.unionByName(rows.where(F.col(id_col).isNull()).withColumn(result, F.lit(None).cast(found.schema[result].dataType)))
