"""Attempts at pages: which of them the ladder makes and takes, as column expressions over the rungs that it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import OcrKnobs
from ..functions.ocr_score import good_enough, ocr_score
from ..sources.ladder import Rung, later_rungs


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def climbed(attempts: DataFrame, key: str, knobs: OcrKnobs = OcrKnobs()) -> DataFrame:
    """(key, attempt, score, made, failed) of attempts (key, attempt from 1, confidence, words, chars, failed): what the ladder takes of a page, how many
    attempts it made and how many of those failed. attempt is null where nothing was read. The rules are those of sources.ladder.climb.

    The first attempt is at the image as it is, the others are what later rungs see, in order. A page has few attempts, so it is one row of the grouping.
    An attempt without a figure, or with fewer than no words, is one that failed; one whose confidence is no number counts as made and isn't taken.
    """
    row = F.struct("attempt", *[F.col(c).cast(t).alias(c) for c, t in (("confidence", "double"), ("words", "long"), ("chars", "long"))], "failed")
    pages = attempts.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("attempts"))
    places: dict[Rung, list[int]] = {}  # a rung that is named twice sees the last of its attempts
    for k, rung in enumerate((Rung("orig", knobs.mode), *later_rungs(knobs))):
        places.setdefault(rung, []).insert(0, k)
    seen = [F.coalesce(*[F.get("attempts", F.lit(k)) for k in own]) for own in list(places.values())[: max(1, knobs.max_attempts)]]
    n = range(len(seen))
    pages = pages.select(key, *[x.alias(f"r{k}") for k, x in enumerate(seen)])
    told = {}
    for k in n:
        r = F.col(f"r{k}")
        figures = (r["confidence"], r["words"], F.greatest(r["chars"], F.lit(0)))
        missing = r["confidence"].isNull() | r["words"].isNull() | r["chars"].isNull() | (r["words"] < 0)
        told[f"fails{k}"] = F.coalesce(r["failed"], F.lit(False)) | missing
        told[f"score{k}"] = F.when(~F.isnan(r["confidence"]), ocr_score(*figures))
        told[f"good{k}"] = F.coalesce(good_enough(*figures, knobs) & ~F.isnan(r["confidence"]), F.lit(False)) & ~told[f"fails{k}"]
    pages = pages.withColumns(told)
    # one that was read and isn't good enough queues all that follow; a first one that fails queues none
    made = {f"made{k}": F.lit(True) if k == 0 else F.col(f"r{k}").isNotNull() & ~F.col("fails0") & _all([~F.col(f"good{j}") for j in range(k)]) for k in n}
    pages = pages.withColumns(made)
    one = {k: F.struct(F.col(f"score{k}").alias("score"), F.lit(-k).alias("first"), F.col(f"r{k}.attempt").cast("long").alias("attempt")) for k in n}
    read = [F.when(F.col(f"made{k}") & ~F.col(f"fails{k}") & F.col(f"score{k}").isNotNull(), one[k]) for k in n]
    # only the last attempt made can be good enough
    good = [F.when(F.col(f"made{k}") & F.col(f"good{k}"), one[k]) for k in n]
    taken = F.coalesce(*good, F.greatest(*read) if len(read) > 1 else read[0])
    count = lambda flags: sum((f.cast("long") for f in flags), F.lit(0).cast("long"))
    return pages.select(
        key, taken.alias("taken"), count([F.col(f"made{k}") for k in n]).alias("made"), count([F.col(f"made{k}") & F.col(f"fails{k}") for k in n]).alias("failed")
    ).select(key, "taken.attempt", "taken.score", "made", "failed")
