"""OCR attempts as tables: words of a recogniser's TSV to text, the best attempt of a page, and rotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import OcrKnobs
from ..functions.ocr_score import good_enough, ocr_score, weak_evidence
from ..functions.text import js_trim


def tsv_words(rows: DataFrame, line: str = "line") -> DataFrame:
    """Words of TSV lines, other columns kept: rows of level 5 with at least twelve columns and a word."""
    parts = F.split(line, "\t")
    cell = lambda k: F.try_element_at(parts, F.lit(k + 1))
    number = F.regexp_extract(cell(10), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    named = {"level": cell(0), "page": cell(1), "block": cell(2), "par": cell(3), "tsv_line": cell(4), "conf": F.when(number != "", number.cast("double")), "word": js_trim(cell(11))}
    return rows.where(F.size(parts) >= 12).withColumns(named).where("level = '5' AND word <> ''")


def tsv_text(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, text, mean_confidence, word_count) of words (page, block, par, tsv_line, conf, word) in order.

    Words of a line are joined by spaces, and a line ends where the key changes from one word to the next. A confidence counts if it is
    finite and not negative; the word itself always counts.
    """
    row = F.struct(F.col(order).alias("o"), F.struct("page", "block", "par", "tsv_line").alias("at"), "conf", "word")
    listed = words.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    rows = F.col("rows")

    def joined(x: Column, i: Column) -> Column:
        before = F.when(i == 0, "").when(F.get(rows, i - 1)["at"] == x["at"], " ").otherwise("\n")
        return F.concat(before, x["word"])

    usable = F.transform(F.filter("rows", lambda x: (x["conf"] >= 0) & (x["conf"] < float("inf"))), lambda x: x["conf"])
    total = F.aggregate("confs", F.lit(0.0), lambda s, c: s + c)
    return listed.withColumn("confs", usable).select(
        *keys,
        F.array_join(F.transform("rows", joined), "").alias("text"),
        F.coalesce(total / F.nullif(F.size("confs"), F.lit(0)), F.lit(0.0)).alias("mean_confidence"),
        F.size("rows").cast("long").alias("word_count"),
    )


def best_attempt(attempts: DataFrame, keys: list[str], knobs: OcrKnobs = OcrKnobs()) -> DataFrame:
    """(keys, attempt, score, confidence, words, chars, good) of attempts (attempt from 1, confidence, words, chars).

    Attempts end at the first that is good enough, which then is taken, or after max_attempts; else the best score is, and the first of equals.
    """
    good = good_enough(F.col("confidence"), F.col("words"), F.col("chars"), knobs)
    tried = attempts.where(F.col("attempt") <= knobs.max_attempts)
    scored = tried.withColumns({"score": ocr_score(F.col("confidence"), F.col("words"), F.col("chars")), "good": good})
    row = F.struct("attempt", "score", "confidence", "words", "chars", "good")
    chosen = F.coalesce(F.min_by(row, F.when(F.col("good"), F.col("attempt"))), F.max_by(row, F.struct("score", (-F.col("attempt")).alias("first"))))
    return scored.groupBy(*keys).agg(chosen.alias("r")).select(*keys, "r.*")


def rotation_choice(best: DataFrame, rotated: DataFrame, keys: list[str], angles: list[int], knobs: OcrKnobs = OcrKnobs()) -> DataFrame:
    """(keys, angle, score): best's angle 0, or that of the rotation (angle, confidence, words, chars) that beats it.

    Rotations are tried only if enabled and best is neither good enough nor more than weak evidence; of the first
    rotate_max_attempts angles one counts if it has words enough and gains enough on the unrotated score; the first best is taken.
    """
    cells = (F.col("confidence"), F.col("words"), F.col("chars"))
    base = best.withColumns({"base_score": ocr_score(*cells), "eligible": F.lit(knobs.rotate) & ~good_enough(*cells, knobs) & weak_evidence(*cells, knobs)}).select(*keys, "base_score", "eligible")
    tried = angles[: knobs.rotate_max_attempts]
    rank = F.coalesce(*[F.when(F.col("angle") == a, i) for i, a in enumerate(tried)], F.lit(None).cast("int"))
    candidates = rotated.withColumns({"rot_score": ocr_score(*cells), "rank": rank}).where(F.col("rank").isNotNull() & (F.col("words") >= knobs.rotate_min_words))
    taken = base.join(candidates.select(*keys, "angle", "rot_score", "rank"), keys, "left")
    counts = F.col("eligible") & (F.col("rot_score") - F.col("base_score") >= knobs.rotate_min_gain)
    top = F.max_by(F.struct("angle", F.col("rot_score").alias("score")), F.when(counts, F.struct("rot_score", (-F.col("rank")).alias("first"))))
    return taken.groupBy(*keys, "base_score").agg(top.alias("r")).select(*keys, F.coalesce("r.angle", F.lit(0)).cast("int").alias("angle"), F.coalesce("r.score", "base_score").alias("score"))


#: How a failed chunk's error is told of its file. Fixed value.
CHUNK_ERROR = "Erro no processamento OCR: "


def chunk_errors(outcomes: DataFrame) -> DataFrame:
    """(file_id, chunks, failed_chunks, ocr_error) of outcomes (file_id, first, error), a row or more for each chunk: one chunk that fails makes the
    OCR of its file fail, with the error of the first such chunk. Attempts that failed within a chunk aren't errors."""
    told = outcomes.groupBy("file_id", "first").agg(F.min("error").alias("error"))
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("first")))
    return told.groupBy("file_id").agg(F.count("*").alias("chunks"), F.count("error").alias("failed_chunks"), F.concat(F.lit(CHUNK_ERROR), first).alias("ocr_error"))
