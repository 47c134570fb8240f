"""The corpus pipeline: documents through five operators of pagemill.llm, each stage's rows written before the next reads them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.exact_dedup import exact_dedup
from pagemill.llm.language import UNDETERMINED, identify_language
from pagemill.llm.mixing import mix_sources
from pagemill.llm.ngram_join import drop_near
from pagemill.llm.packing import pack
from pagemill.llm.tables import table
from pagemill.plans.tables import spread
from pagemill.sources.folders import remove, scratch, scratch_path

#: A document whose pooled language probability is below this is in none of the learnt languages.
LEAST_SCORE = 0.4


#: What the operators read of a document. Its other columns go with it in one struct, so that none meets a result of its name.
READ = ("doc_id", "text", "lang", "source")


def _through(docs: DataFrame, operate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that operate leaves of docs, with the columns of docs as they were."""
    others = [c for c in docs.columns if c not in READ]
    packed = docs.select(*[c for c in docs.columns if c in READ], F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`").alias(str(k)) for k, c in enumerate(others, 1)]).alias("others_of_docs"))
    place = {c: F.col("others_of_docs")[str(k)].alias(c) for k, c in enumerate(others, 1)}
    return operate(packed).select(*[place.get(c, F.col(c)) for c in docs.columns])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or that the network puts in no language with LEAST_SCORE, go."""
    return _through(docs, lambda d: identify_language(d).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)))


def drop_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the largest doc_id stays."""
    return _through(docs, lambda d: exact_dedup(d).where("kept"))


def drop_near_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near texts the smallest doc_id stays; a row with a null doc_id is in no group."""
    return drop_near(docs).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document comes as often as the mix takes it, from not at all to twice; one without words isn't taken."""
    return _through(docs, lambda d: mix_sources(d).where("taken > 0").withColumn("taken", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("taken div size")))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of sequences of 1024 tokens."""
    return pack(docs.select(*[c for c in docs.columns if c in READ]))


STAGES = [
    ("language id", keep_known_languages),
    ("exact dedup", drop_equal_texts),
    ("n-gram jaccard join", drop_near_texts),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]

#: SQL can't express a trained network, nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written before the next reads them. What a stage keeps on its way, and the rows that it was given, are
    removed when its own are written; those of the last one stay, as its rows are read later."""
    docs = spread(table(spark, sf_dir, "documents"))
    before = None
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline")
        with scratch(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
