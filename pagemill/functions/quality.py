"""How good native text is: diagnostics of a page and analysis of a document, as struct columns."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_AFTER_WORD, NOT_BEFORE_WORD, SPACE_SET, blank_count, fragment_count, js_length, js_trim, letter_digit_count, lone_digit_count, repetition, trimmed_lines, white_count, word_count

#: Classes of a page's text. Fixed values.
PAGE_CLASSES = ("empty", "short-text", "corrupted-text", "repetitive-text", "native-text", "ocr-candidate")

#: Lines of content: pattern and whether case counts. Fixed values.
CONTENT_PATTERNS = (
    (r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", True),
    (r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b", True),
    (r"matrícula\s*n[°º]\s*\d+", False),
    (r"livro\s*n[°º]\s*\d+", False),
    (r"R\$\s*[\d.,]+", True),
    (r"\d{1,2}\s+de\s+\w+\s+de\s+\d{4}", False),
    (r"\d{2}/\d{2}/\d{4}", True),
    (r"certifico\s+(?:que|e\s+dou\s+fé)", False),
    (r"brasileiro\w*,?\s+\w+", False),
)
#: Lines of letterheads; case doesn't count. Fixed values.
HEADER_PATTERNS = (
    r"REPÚBLICA FEDERATIVA DO BRASIL",
    r"COMARCA DE",
    r"REGISTROS CIVIS",
    r"Página \d+ de \d+",
    r"Certidão de",
    r"Oficial Titular",
    r"Telefone",
    r"WhatsApp",
    r"OFÍCIO DE REGISTRO",
    r"REGISTRO DE IM[ÓO]VEIS",
    r"T[ÍI]TULOS E DOCUMENTOS",
    r"REGISTRO CIVIL DAS PESSOAS",
    r"Oficial Registradora",
    r"Fone:",
    r"Site:",
    r"Pedido n[°º]",
    r"Validade:",
    r"Solicite sua certidão",
    r"Documento assinado digitalmente",
    r"Valide este documento",
    r"assinador-web\.onr\.org\.br",
    r"registradores\.onr\.org\.br",
    r"Selo Digital de Fiscalização",
    r"Confira os dados do ato em",
    r"CERTID[ÃA]O DE INTEIRO TEOR",
    r"CERTID[ÃA]O",
)


def any_of(patterns: tuple[tuple[str, bool], ...], before: str, after: str, ignore_case: str) -> str:
    """One pattern for lines in which any of patterns is found; before and after are what tells a boundary before and after a digit."""
    parts = (p.replace(r"\b\d", before + r"\d").replace(r"\b", after).replace(r"\s", f"[{SPACE_SET}]") for p, _ in patterns)
    return "|".join(p if exact else f"(?{ignore_case}:{p})" for p, (_, exact) in zip(parts, patterns, strict=True))


def _java(patterns: tuple[tuple[str, bool], ...]) -> str:
    return any_of(patterns, NOT_AFTER_WORD, NOT_BEFORE_WORD, "iu")


_HEADER_PATTERNS = tuple((p, False) for p in HEADER_PATTERNS)
CONTENT = _java(CONTENT_PATTERNS)
HEADER = _java(_HEADER_PATTERNS)
#: Characters that a pattern without case takes for an s or an i, and whose lower case is another.
_ODD_CASE = "\u017f\u0131\u0130"


def literal_of(pattern: str) -> str:
    """The longest text that all that a pattern matches holds, in lower case; empty for one that begins with a digit."""
    if re.match(r"(\\b)?\\d", pattern):
        return ""
    # what has a quantifier or choices, or is a class, may be absent or another
    plain = re.sub(r"\(\?:.*|\[[^\]]*\][*+?]?|\\[A-Za-z][*+?]?|.[*?]", "\0", pattern.replace(r"\$", "$").replace(r"\.", "."))
    return max(plain.split("\0"), key=len).lower()


def may_match(text: Column, low: Column, patterns: tuple[tuple[str, bool], ...]) -> Column:
    """Whether one of patterns may be found in a text, low being its lower case: if not, none is. Finding texts is far cheaper than many patterns."""
    literals = {literal_of(p) for p, _ in patterns} - {""}
    tests = [low.contains(x) for x in sorted(literals)] + [text.contains(c) for c in _ODD_CASE]
    numbers = tuple((p.replace(r"\b", ""), exact) for p, exact in patterns if not literal_of(p))
    if numbers:
        tests.append(text.rlike(f"(?=[0-9])(?:{any_of(numbers, '', '', 'iu')})"))
    return reduce(or_, tests)


def quality_score(length: Column, high_quality: Column, repetitive: Column, ocr_indicators: Column, substantial: Column) -> Column:
    points = ((40, high_quality), (30, substantial), (20, ~repetitive), (10, ~ocr_indicators), (10, (length > 1000) & (length < 50000)))
    return F.least(sum((F.when(c, p).otherwise(0) for p, c in points), F.lit(0)), F.lit(100)).cast("int")


def with_page_diagnostics(df, text: str = "text"):
    """df with diag: struct of a page's text diagnostics. Values used more than once are set out in their own projection."""
    t = F.col("page_t_")
    df = df.withColumn("page_raw_", F.coalesce(F.col(text), F.lit(""))).withColumn("page_t_", js_trim(F.col("page_raw_")))
    df = df.withColumns(
        {
            "page_n_": js_length(t),
            "page_words_": word_count(t),
            "page_alnum_": letter_digit_count(t),
            "page_white_": white_count(t),
            "page_blank_": blank_count(t),
            "page_lines_": trimmed_lines(t),
            "page_bad_": t.contains("�"),
        }
    ).withColumn("page_rep_", repetition(F.col("page_lines_")))
    n, words, rep = F.col("page_n_"), F.col("page_words_"), F.col("page_rep_")
    over = F.greatest(n, F.lit(1))
    alnum, density = F.col("page_alnum_") / over, F.col("page_blank_") / over
    empty, poor = n == 0, (n < 300) | F.col("page_bad_")
    usable = ~empty & ~poor
    repetitive = usable & (rep > 0.65)
    indicators = ~empty & (poor | (density > 0.45))
    high = usable & (alnum >= 0.55) & (words >= 40) & (density <= 0.45)
    substantial = usable & (n >= 500) & (words >= 40)
    skip = high & substantial & ~repetitive
    score = F.when(empty, 0).when(poor, 10).otherwise(quality_score(n, high, repetitive, indicators, substantial)).cast("int")
    kind = (
        F.when(empty, "empty").when(F.col("page_bad_"), "corrupted-text").when(n < 300, "short-text").when(repetitive, "repetitive-text").when(skip, "native-text").otherwise("ocr-candidate")
    )
    diag = F.struct(
        js_length(F.col("page_raw_")).alias("text_length"),
        n.alias("trimmed_length"),
        words.alias("word_count"),
        alnum.alias("alphanumeric_ratio"),
        (F.col("page_white_") / over).alias("whitespace_ratio"),
        density.alias("space_density"),
        rep.alias("repetition_ratio"),
        F.col("page_bad_").alias("has_corruption"),
        kind.alias("classification"),
        skip.alias("should_skip_ocr"),
        high.alias("is_high_quality"),
        repetitive.alias("is_repetitive"),
        indicators.alias("has_ocr_indicators"),
        substantial.alias("has_substantial_content"),
        score.alias("quality_score"),
    )
    return df.withColumn("diag", diag).drop("page_raw_", "page_t_", "page_n_", "page_words_", "page_alnum_", "page_white_", "page_blank_", "page_lines_", "page_rep_", "page_bad_")


def matching_lines(text: Column, low: Column, lines: Column, patterns: tuple[tuple[str, bool], ...]) -> Column:
    """How many lines one of patterns is found in. What is found in a line is found in its text, so most texts are read once and not line by line."""
    pattern = _java(patterns)
    return F.when(may_match(text, low, patterns) & text.rlike(pattern), F.size(F.filter(lines, lambda x: x.rlike(pattern)))).otherwise(F.lit(0)).cast("long")


def with_document_analysis(df, text: str = "text"):
    """df with quality: struct of a whole document's text analysis."""
    t, raw = F.col("doc_t_"), F.col("doc_raw_")
    df = df.withColumn("doc_raw_", F.coalesce(F.col(text), F.lit(""))).withColumn("doc_t_", js_trim(F.col("doc_raw_")))
    df = df.withColumns({"doc_n_": js_length(raw), "doc_size_": js_length(t), "doc_lines_": trimmed_lines(t, longer_than=5), "doc_low_": F.lower(t)})
    long_enough = (F.col("doc_size_") > 0) & (F.col("doc_n_") >= 2000)
    lines_ = F.col("doc_lines_")
    df = df.withColumns(
        {
            "doc_count_": F.size(lines_).cast("long"),
            "doc_content_": matching_lines(t, F.col("doc_low_"), lines_, CONTENT_PATTERNS),
            "doc_header_": matching_lines(t, F.col("doc_low_"), lines_, _HEADER_PATTERNS),
            "doc_rep_": repetition(lines_),
            "doc_alnum_": letter_digit_count(t),
            "doc_blank_": blank_count(t),
            "doc_fragments_": fragment_count(t),
            "doc_digits_": lone_digit_count(t),
        }
    )
    over = F.greatest(F.col("doc_size_"), F.lit(1))
    broken = long_enough & (t.contains("�") | (F.col("doc_count_") < 3))
    whole = long_enough & ~broken
    repetitive = whole & (F.col("doc_rep_") > 0.6)
    high = whole & (F.col("doc_alnum_") / over > 0.6)
    marked = (F.col("doc_fragments_") > 10) | (F.col("doc_digits_") > 20) | (F.col("doc_blank_") / over > 0.4)
    indicators = (F.col("doc_size_") > 0) & (~whole | marked)
    substantial = whole & (F.col("doc_content_") >= 3) & (F.col("doc_header_") / F.greatest(F.col("doc_count_"), F.lit(1)) <= 0.4)
    score = F.when(F.col("doc_size_") == 0, 0).when(~long_enough, 10).otherwise(quality_score(F.col("doc_n_"), high, repetitive, indicators, substantial)).cast("int")
    quality = F.struct(
        F.col("doc_n_").alias("text_length"),
        F.col("doc_count_").alias("line_count"),
        F.col("doc_content_").alias("content_lines"),
        F.col("doc_header_").alias("header_lines"),
        F.col("doc_rep_").alias("line_repetition"),
        F.col("doc_alnum_").alias("alphanumeric_count"),
        F.col("doc_blank_").alias("space_count"),
        F.col("doc_fragments_").alias("fragmented_words"),
        F.col("doc_digits_").alias("isolated_digits"),
        (~repetitive & ~indicators & high & substantial).alias("should_skip_ocr"),
        high.alias("is_high_quality"),
        repetitive.alias("is_repetitive"),
        indicators.alias("has_ocr_indicators"),
        substantial.alias("has_substantial_content"),
        score.alias("quality_score"),
    )
    gone = ("doc_t_", "doc_low_", "doc_raw_", "doc_n_", "doc_size_", "doc_lines_", "doc_count_", "doc_content_", "doc_header_", "doc_rep_", "doc_alnum_", "doc_blank_", "doc_fragments_", "doc_digits_")
    return df.withColumn("quality", quality).drop(*gone)


def min_chars_per_page(pages: Column) -> Column:
    return F.when(pages <= 1, 300).when(pages == 2, 650).otherwise(900)


def ocr_bypass(quality: Column, total_pages: Column) -> Column:
    """struct of chars_per_page, strong and skip: whether a document's native text stands without OCR."""
    pages = F.greatest(F.coalesce(total_pages, F.lit(0)), F.lit(1))
    per_page = quality["text_length"] / pages
    enough = per_page >= min_chars_per_page(pages)
    strong = quality["is_high_quality"] & quality["has_substantial_content"] & ~quality["is_repetitive"] & enough & (quality["text_length"] >= 8000)
    return F.struct(per_page.alias("chars_per_page"), strong.alias("strong"), (strong | (quality["should_skip_ocr"] & enough)).alias("skip"))
