import math
import random
import re
import string
import time
from collections import Counter

from pyspark.sql import functions as F

from pagemill.llm import secrets
from pagemill.llm.secrets import BINS, ENCODINGS, LEAST_POWER, TOKEN, _spans, dismissed, scan_secrets


def test_random_part_of_a_path(spark):
    r = random.Random(5)
    keys = ["".join(r.choices(string.ascii_letters + string.digits, k=k)) for k in range(24, 54)]
    texts = [f"é at https://h.com/reset-password/{k} or" for k in keys] + [f"a/b_{k}/{k[::-1]} or" for k in keys] + ["see https://h.com/what-to_do/with/a-1/long/path-of_words"]
    got = {x.n: [texts[x.n][s["start"] : s["end"]] for s in x.spans] for x in scan_secrets(spark.createDataFrame(list(enumerate(texts)), "n int, text string")).collect()}
    n = len(keys)
    assert sum(got[k] == [keys[k]] for k in range(n)) >= 0.95 * n
    assert sum(got[n + k] == [keys[k], keys[k][::-1]] for k in range(n)) >= 0.9 * n
    assert got[2 * n] == []


def p_value(token, letters):
    """The battery by its definition."""
    n, k = len(token), len(letters)
    tail = lambda z: max(0.5 * math.erfc(z / math.sqrt(2)), 10.0**-LEAST_POWER)
    both = lambda z: min(2 * tail(abs(z)), 1.0)
    chi = sum((token.count(c) - n / k) ** 2 / (n / k) for c in letters)
    x = [letters.index(c) + 1 - (k + 1) / 2 for c in token]
    high = sum(v > 0 for v in x)
    runs = 1 + sum((a > 0) != (b > 0) for a, b in zip(x, x[1:]))
    expected = 2 * high * (n - high) / n + 1
    z_runs = 10.0 if high in (0, n) else (runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    mean = sum(x) / n
    variance = max(sum(v * v for v in x) / n - mean * mean, 1e-9)
    serial = ((sum(a * b for a, b in zip(x, x[1:])) / (n - 1) - mean * mean) / variance + 1 / n) * math.sqrt(n)
    half = -math.log(tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n)))) - math.log(both(z_runs)) - math.log(both(serial))
    return min(max(math.exp(-half) * (1 + half + half * half / 2), 10.0**-LEAST_POWER), 1.0)


def tokens_of_all_kinds():
    r = random.Random(11)
    kinds = [letters for _, letters, _ in ENCODINGS] + ["ab", "aB1", "01"]
    return ["".join(r.choices(letters, k=r.randint(20, 90))) for letters in kinds for _ in range(25)] + [w * 12 for w in ("word", "Ab1/", "x-1_", "deadbeef0", "1234567890")]


def test_battery_by_definition(spark):
    tokens = tokens_of_all_kinds()
    df = spark.createDataFrame([(f"({t})",) for t in tokens], "text string").select("text", secrets.tested(_spans(F.col("text"), TOKEN)).alias("t"))
    got = {r.text[1:-1]: [(t["start"], t["end"], t["band"], t["bin"]) for t in r.t] for r in df.collect()}
    several = 0
    for token in tokens:
        fit = next(((letters, least) for pattern, letters, least in ENCODINGS if re.match(pattern, token)), None)
        if fit is None:
            continue  # cut in parts, tested above
        letters, least = fit
        if len(token) * math.log2(len(letters)) < least:
            assert got[token] == []
            continue
        [(start, end, band, bin_)] = got[token]
        exact = -math.log10(p_value(token, letters)) * BINS
        assert (start, end, band) == (1, 1 + len(token), int(math.log2(len(token))))
        assert bin_ <= exact + 0.02 and exact - 0.02 < bin_ + 1, (token, bin_, exact)
        several += 1
    assert several > 200


def test_false_discovery_control_by_definition(spark):
    r = random.Random(2)
    rows = [(band, min(int(-math.log10(r.random() ** r.choice([1, 1, 6])) * BINS), BINS * LEAST_POWER)) for band in (4, 5, 6) for _ in range(300)] + [(9, 0), (10, 240)]
    want = {}
    for band in {b for b, _ in rows}:
        own = Counter(x for b, x in rows if b == band)
        total = sum(own.values())
        hits = [x for x in own if 10 ** (-x / BINS) <= 0.01 * sum(n for y, n in own.items() if y >= x) / total]
        if hits:
            want[band] = min(hits)
    assert dismissed(spark.createDataFrame(rows, "band int, bin int"), 0.01) == want


def test_letters_or_digits_alone(spark):
    r = random.Random(4)
    keys = ["".join(r.choices(string.ascii_letters, k=24)) for _ in range(40)] + ["".join(r.choices(string.ascii_lowercase, k=40)) for _ in range(40)] + ["".join(r.choices(string.digits, k=40)) for _ in range(40)]
    words = ["internationalization" * 2, "getElementsByClassNameAndAttribute", "Donaudampfschifffahrtsgesellschaft", "aaaaaaaaaabbbbbbbbbbccccccccccdddddddddd", "1111111111111111111111111111", "IMPORTANTANNOUNCEMENTTOALLREADERS"]
    texts = [f"it is {x}." for x in keys + words]
    got = {x.n: x.spans for x in scan_secrets(spark.createDataFrame(list(enumerate(texts)), "n int, text string")).collect()}
    assert sum(bool(got[k]) for k in range(120)) >= 114
    assert [texts[k] for k in range(120, len(texts)) if any(s["kind"] == "random" for s in got[k])] == []


def test_null_columns_repeated_rows_and_many_matches(spark):
    key = "".join(random.Random(8).choices(string.ascii_letters + string.digits, k=40))
    rows = [(None, None), (None, f"see {key}"), (1, f"see {key}"), (1, f"see {key}"), (2, "")]
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(len(r.spans) for r in got) == [0, 0, 1, 1, 1]
    assert all(len(r.spans) == 0 for r in scan_secrets(spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string")).collect())
    n = 24_000
    text = "é " + " ".join(f"{k:024x}" for k in range(n))
    began = time.perf_counter()
    [one] = scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s["start"], s["end"]) for s in one.spans if s["kind"] == "hex"] == [(2 + 25 * k, 26 + 25 * k) for k in range(n)]
    assert time.perf_counter() - began < 120
