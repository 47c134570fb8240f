"""Scores and predicates of OCR attempts, and parsing of OCR settings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import OcrKnobs
from .text import SPACE, js_trim


def ocr_score(confidence: Column, words: Column, chars: Column) -> Column:
    return F.least(F.greatest(confidence, F.lit(0.0)), F.lit(100.0)) + F.least(chars / 120, F.lit(35.0)) + F.least(12 * F.log10(words + F.lit(1.0)), F.lit(25.0)) * 1.2


def good_enough(confidence: Column, words: Column, chars: Column, knobs: OcrKnobs = OcrKnobs()) -> Column:
    return (confidence >= knobs.good_confidence) & (words >= knobs.good_words) & (chars >= knobs.good_chars)


def weak_evidence(confidence: Column, words: Column, chars: Column, knobs: OcrKnobs = OcrKnobs()) -> Column:
    return (words <= knobs.weak_words) | (confidence <= knobs.weak_confidence) | (chars <= knobs.weak_chars)


def rotation_angles(setting: Column) -> Column:
    """The quarter turns that a comma-separated setting names, each once, in its order."""
    numbers = F.transform(F.split(setting, ","), lambda x: F.regexp_extract(x, r"^\s*([+-]?\d{1,9})", 1))
    return F.array_distinct(F.filter(F.transform(numbers, lambda x: F.when(x != "", x.cast("int"))), lambda x: x.isin(90, 180, 270)))


def pages_in_probe(output: Column) -> Column:
    """The page count that a PDF probe printed; null where there is none."""
    found = F.regexp_extract(output, r"Pages:\s+(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def version_in_probe(output: Column) -> Column:
    found = F.regexp_extract(output, r"(\d+\.\d+\.\d+)", 1)
    return F.when(found != "", found)


def languages_listed(output: Column) -> Column:
    """The languages that a recogniser lists, one to a line after a heading; none where it printed nothing."""
    lines = F.transform(F.split(F.coalesce(output, F.lit("")), r"\r?\n"), js_trim)
    told = F.filter(lines, lambda x: (x != "") & ~F.lower(x).contains("list of available languages"))
    return F.array_distinct(F.transform(told, lambda x: F.element_at(F.split(x, SPACE + "+"), 1)))


def ocr_language(output: Column, preferred: Column) -> Column:
    """The language to recognise in: the one that is set, else Portuguese, with English where both are listed."""
    own, listed = js_trim(F.coalesce(preferred, F.lit(""))), languages_listed(output)
    return F.when(own != "", own).when(F.array_contains(listed, "por") & F.array_contains(listed, "eng"), "por+eng").otherwise("por")
