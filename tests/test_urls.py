import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions.urls import percent_encoded, punycode, redact_url, without_dots


def test_punycode(spark):
    r = random.Random(4)
    letters = "abcxyz019-" + "éüßñçøå" + "日本語語語" + "😀𝒳" + "пример"
    labels = ["bücher", "münchen", "例え", "ليهمابتكلموشعربي؟", "3年b組金八先生", "安室奈美恵-with-super-monkeys", "é", "éé", "aéa", "ü" * 40, "z" * 30 + "ł"] + ["".join(r.choice(letters) for _ in range(r.randrange(1, 24))) for _ in range(300)]
    labels = [x for x in labels if not x.isascii()]
    df = spark.createDataFrame([(x,) for x in labels], "x string")
    got = {row.x: row.p for row in df.select("x", punycode(F.col("x")).alias("p")).collect()}
    assert got == {x: x.encode("punycode").decode() for x in labels}


@pytest.mark.parametrize(
    "path, want",
    [("/a/./b", "/a/b"), ("/a/../b", "/b"), ("/../../b/", "/b/"), ("/a/b/..", "/a/"), ("/a/b/.", "/a/b/"), ("/a/%2E%2e/b/.%2E", "/"), ("/.a/..b", "/.a/..b"), ("/a//../b", "/a/b"), ("/", "/"), ("/..", "/"), ("/a/.../b", "/a/.../b")],
)
def test_dots(spark, path, want):
    assert spark.range(1).select(without_dots(F.lit(path))).first()[0] == want


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://Bücher.Example.COM:443/a/../ç d", "https://xn--bcher-kva.example.com/%C3%A7%20d"),
        ("http://h.example:080/a\\b\\..\\c", "http://h.example/a/c"),
        ("http://h.example:8080/x?y#é", "http://h.example:8080/x?[redacted-query]#%C3%A9"),
        ("https://us er:p:w@h.example/", "https://us%20er:p%3Aw@h.example/"),
        ("https://:@h.example", "https://h.example/"),
        ("  https://h.example/a\n b\t ", "https://h.example/a%20b"),
        ("http://%62%C3%BCcher.example/", "http://xn--bcher-kva.example/"),
        ("http://例え。テスト/😀", "http://xn--r8jz45g.xn--zckzah/%F0%9F%98%80"),
        ("http://[2001:DB8::1]:81/", "http://[2001:db8::1]:81/"),
        ("http://h.example:99999/", "[invalid-url]"),
        ("http://a%20b.example/", "[invalid-url]"),
        ("http://a<b/", "[invalid-url]"),
        ("no url", "[invalid-url]"),
        (None, "[invalid-url]"),
        ("foo://h", "foo://h"),
        ("http://h.example/%zz/{a}|^", "http://h.example/%zz/%7Ba%7D|^"),
        ("http://h.example?#", "http://h.example/?#"),
    ],
)
def test_normal_form(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(redact_url(F.col("u"))).first()[0] == want


def test_bytes(spark):
    assert spark.range(1).select(percent_encoded(F.lit("aé\x00😀b"), r"[^a-z]")).first()[0] == "a%C3%A9%00%F0%9F%98%80b"
