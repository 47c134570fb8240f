import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions.quality import ocr_bypass, with_document_analysis, with_page_diagnostics
from pagemill.functions.urls import basename, redact_url, redact_urls_in
from pagemill.operators.pages import legacy_decision

SENTENCES = " ".join(
    ["A empresa declara que o documento descreve o contrato de prestação de serviços entre as partes interessadas."]
    + ["O texto nativo desta página foi extraído diretamente e contém informações completas sobre prazos e valores."]
    + ["As partes concordam com as condições descritas neste instrumento particular de compromisso e responsabilidade."]
)


def diag(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return [r.diag for r in with_page_diagnostics(df).orderBy("k").collect()]


def test_page_classes(spark):
    readable = (SENTENCES + " ") * 6
    good, short, empty, broken, again, none = diag(
        spark, readable, "Assinatura", "   \n\t", readable + " �� ��", "\n".join(["LINHA REPETIDA COM CONTEUDO NATIVO 12345"] * 80), None
    )
    assert good.classification == "native-text" and good.should_skip_ocr and good.is_high_quality and not good.has_ocr_indicators
    assert good.word_count >= 80 and good.alphanumeric_ratio > 0.55 and good.repetition_ratio == 0
    assert short.classification == "short-text" and short.trimmed_length == 10 and short.has_ocr_indicators and not short.should_skip_ocr
    assert empty.classification == "empty" and (empty.text_length, empty.trimmed_length, empty.word_count) == (5, 0, 0) and not empty.has_ocr_indicators
    assert broken.classification == "corrupted-text" and broken.has_ocr_indicators and broken.quality_score == 10
    assert again.classification == "repetitive-text" and again.repetition_ratio > 0.65 and again.is_repetitive
    assert none.classification == "empty" and none.text_length == 0


def test_page_gap_between_high_quality_and_substantial(spark):
    (page,) = diag(spark, ("palavra " * 50).strip())
    assert page.trimmed_length == 399 and page.classification == "ocr-candidate" and page.is_high_quality and not page.should_skip_ocr


def test_astral_characters_count_twice(spark):
    (page,) = diag(spark, "😀a")
    assert page.trimmed_length == 3


@pytest.mark.parametrize(
    "text, clean",
    [
        ("a\x0by", "ay"),
        ("a\r\nb", "a\n\nb"),
        ("a\n\n---\n\nb", "a b"),
        ("https://a.b", "https a.b"),
        ("a...b", "a b"),
        ("“x” – €", "x"),
        ("a​b\xa0c", "a b c"),
        ("x😀y", "x  y"),
        ("=== ABA ===", "ABA"),
        ("a\n\n\n\n\nb", "a b"),
        ("　 a ", "a"),
        (None, ""),
    ],
)
def test_sanitize_text(spark, text, clean):
    assert spark.createDataFrame([(text,)], "t string").select(X.sanitize_text(F.col("t"))).first()[0] == clean


def test_sanitize_and_trim(spark):
    row = spark.createDataFrame([("﻿ a \n b\xa0",)], "t string").select(X.sanitize(F.col("t")), X.js_trim(F.col("t"))).first()
    assert tuple(row) == ("a b", "a \n b")


def test_boundaries_are_ascii(spark):
    df = spark.createDataFrame([("xé a b c, 1 23 é9",)], "t string")
    row = df.select(X.fragment_count(F.col("t")), X.lone_digit_count(F.col("t"))).first()
    assert tuple(row) == (1, 2)


def document(spark, text, pages=6, n_bytes=1000):
    df = spark.createDataFrame([(text, pages, n_bytes)], "text string, pages int, bytes long")
    q = with_document_analysis(df)
    return q.select("quality", ocr_bypass(F.col("quality"), F.col("pages")).alias("bypass"), legacy_decision(F.col("quality"), F.col("pages"), F.col("bytes")).alias("d")).first()


BODY = "\n".join(f"Linha {k}xx com R$ 1{k}00,00 pago em 10/10/20{k % 90 + 10} por brasileiro casado conforme contrato firmado" for k in range(150))


def test_document_patterns_and_bypass(spark):
    r = document(spark, BODY)
    assert r.quality.content_lines == 150 and r.quality.header_lines == 0 and r.quality.has_substantial_content
    assert r.quality.should_skip_ocr and r.bypass.strong and r.bypass.skip and r.d.reason == "strong-direct-text"


def test_document_headers_outweigh(spark):
    r = document(spark, BODY + "\n" + "\n".join(f"Telefone {k} CERTIDÃO DE INTEIRO TEOR" for k in range(200)))
    assert r.quality.header_lines == 200 and not r.quality.has_substantial_content and r.d.reason == "insufficient-text"


def test_scanned_looking_document(spark):
    marked = BODY + "\n" + "\n".join(f"{k % 10} x{k} final da linha" for k in range(30))
    assert document(spark, marked, 6, 6 * 50_001).d.reason == "looks-scanned"
    assert document(spark, marked, 6, 6 * 50_000).d.reason == "filesize-validated"


def test_short_and_blank_documents(spark):
    assert document(spark, "x" * 1999).quality.quality_score == 10
    blank = document(spark, " \n ")
    assert blank.quality.quality_score == 0 and not blank.quality.has_ocr_indicators
    assert document(spark, BODY, 0).d.reason == "no-pages" and document(spark, BODY, 5).d.reason == "always-ocr"


@pytest.mark.parametrize(
    "url, redacted, name",
    [
        ("https://storage.example.com/documents/file.pdf?token=abc&x=1", "https://storage.example.com/documents/file.pdf?[redacted-query]", "file.pdf"),
        ("not a valid url", "[invalid-url]", None),
        ("HTTPS://User:pw@Example.COM:443", "https://User:pw@example.com/", None),
        ("https://user:pw@example.com/a%20b?q#f", "https://example.com/a%20b?[redacted-query]#f", "a%20b"),
        ("http://example.com:8080/a/b/", "http://example.com:8080/a/b/", "b"),
    ],
)
def test_urls(spark, url, redacted, name):
    row = spark.createDataFrame([(url,)], "u string").select(redact_url(F.col("u")), basename(F.col("u"))).first()
    assert row[0] == redacted
    if name:
        assert row[1] == name


def test_urls_in_messages(spark):
    df = spark.createDataFrame([("at https://a.b/c?d=1 and http://e.f/g.",), ("none",)], "m string")
    assert [r[0] for r in df.select(redact_urls_in(F.col("m"))).collect()] == ["at https://a.b/c?[redacted-query] and http://e.f/g.", "none"]
