"""Costly expressions are worked out once for a row."""

from __future__ import annotations

from pagemill.functions.quality import CONTENT_PATTERNS, HEADER_PATTERNS, any_of, literal_of, matching_lines, may_match
from pagemill.functions.text import NO_LETTERS_DIGITS, NOT_AFTER_WORD, NOT_BEFORE_WORD, SANITIZE_STEPS, count_without, letter_digit_count
from pagemill.plans import queries as plans
from pyspark.sql import functions as F

HEADER_PATTERNS_OF = tuple((p, False) for p in HEADER_PATTERNS)


def test_a_page_is_sanitized_once(spark):
    found = plans.QUERIES["sidecar_filter"](spark, "/root/testdata/sf0.001")
    told = found._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("regexp_replace(") == len(SANITIZE_STEPS) - 1


def test_letters_and_digits_are_counted_as_by_their_pattern(spark):
    texts = ["", None, "Aé9 ×÷ ÿĀ_-\n\t 𝔸é", "a" * 50 + "·" * 50, "".join(map(chr, range(0x20, 0x250)))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    told = df.select(letter_digit_count(F.col("t")), count_without(F.col("t"), NO_LETTERS_DIGITS)).collect()
    assert [a for a, _ in told] == [b for _, b in told]


def test_whatever_a_pattern_takes_for_a_letter_passes_the_test_before_it(spark):
    letters = sorted({c for p in (*HEADER_PATTERNS, *(p for p, _ in CONTENT_PATTERNS)) for c in literal_of(p) if c.isalpha()})
    chars = spark.createDataFrame([(chr(k),) for k in range(1, 0x10000) if not 0xD800 <= k < 0xE000], "c string")
    missed = [F.count_if(F.col("c").rlike(f"(?iu:{x})") & (F.lower("c") != x) & ~F.col("c").isin(*"ſıİ")).alias(f"m{k}") for k, x in enumerate(letters)]
    assert set(chars.agg(*missed).first()) == {0}


def test_lines_are_counted_whether_or_not_texts_are_read(spark):
    found = ["CERTIDÃO DE", "certıdão de", "Página 1 de 20", "título\nTÍTULOS E DOCUMENTOS", "x Pedido nº", "assinador-web.onr.org.br", "regiſtros civis", "OFİCIAL TITULAR"]
    content = ["123.456.789-00", "12.345.678/0001-99", "Matrícula nº 7", "LIVRO N° 3", "R$ 5", "1 de maio de 2020", "01/02/2003", "certifico que", "Brasileiro, solteiro"]
    none = ["", "1234", "1234.567.890-11", "1 dé maio", "r$ 5", "certifico", "fone", "12.3"]
    patterns = {"h": tuple((p, False) for p in HEADER_PATTERNS), "c": CONTENT_PATTERNS}
    df = spark.createDataFrame([(t,) for t in found + content + none], "t string").withColumn("low", F.lower("t")).withColumn("l", F.split("t", "\n"))
    plain = {k: any_of(p, NOT_AFTER_WORD, NOT_BEFORE_WORD, "iu") for k, p in patterns.items()}
    counted = [matching_lines(F.col("t"), F.col("low"), F.col("l"), p).alias(k) for k, p in patterns.items()]
    in_lines = [F.expr(f"size(filter(l, x -> x rlike r'{p}'))").alias(f"{k}_plain") for k, p in plain.items()]
    told = df.select("t", *counted, *in_lines).collect()
    assert all(r["h"] == r["h_plain"] and r["c"] == r["c_plain"] for r in told)
    by = {r["t"]: r for r in told}
    assert all(by[t]["h"] for t in found) and all(by[t]["c"] for t in content) and not any(by[t]["c"] or by[t]["h"] for t in none)
    # a text in which nothing can be found isn't read by the patterns
    assert not df.where("t = 'fone'").select(may_match(F.col("t"), F.col("low"), HEADER_PATTERNS_OF)).first()[0]
