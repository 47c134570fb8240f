import random
import re

import pytest

from pagemill.llm import tables
from pagemill.llm.unit_dedup import LINES, PARAGRAPHS, SENTENCES, drop_repeated_units, units_of

S = "This sentence is one of those that come again, and it has words enough to go by itself, as it says here."


def dedup(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text_kept, r.n_removed, r.n_spans) for r in drop_repeated_units(df, **more).collect()), key=repr)


def by_definition(rows, pattern=SENTENCES, least=20):
    """Text and spans by plain loops; ids are unique."""
    first, out = set(), []
    for doc, text in sorted(r for r in rows if r[0] is not None):
        runs, run = [], None
        for m in re.finditer(pattern, text or ""):
            unit = " ".join(re.split(r"[\x20\x09-\x0D]+", m[0])).strip(" ").lower()
            if not unit:
                continue
            if unit in first:
                run = run or [m.start(), 0, 0]
                run[1], run[2] = m.end(), run[2] + len(unit.split(" "))
            else:
                first.add(unit)
                runs, run = [*runs, run] if run else runs, None
        spans = [r for r in [*runs, run] if r and r[2] >= least]
        left = text
        for a, b, _ in reversed(spans):
            left = left[:a] + left[b:]
        out.append((doc, left, sum(b - a for a, b, _ in spans), len(spans)))
    return sorted(out, key=repr)


def test_units_cover_the_text():
    text = "One two three. Four!\nFive?? six\n\nseven"
    for pattern in (LINES, PARAGRAPHS):
        spans = [(a, b) for a, b, *_ in units_of(text, pattern)]
        assert spans[0][0] == 0 and spans[-1][1] == len(text)


def test_nulls_empty_texts_and_clashing_names(spark):
    # document 1 comes first, so the end of 2 is the first of its kind
    rows = [(2, f"{S} Short one.", "x"), (1, f"Intro. {S.upper()}\n{S}", "x"), (3, None, "x"), (4, "", None), (None, S, None), (5, "short one. short one.", None), (5, "short one. short one.", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    got = sorted(((r.doc_id, r.n_removed, r.n_spans, r.text_kept) for r in drop_repeated_units(df).collect()), key=repr)
    n = len(S)
    assert (2, n, 1, " Short one.") in got and (1, n, 1, f"Intro. {S.upper()}\n") in got
    assert [r for r in got if r[0] not in (1, 2)] == sorted([(3, 0, 0, None), (4, 0, 0, ""), (None, 0, 0, S), (5, 0, 0, "short one. short one."), (5, 0, 0, "short one. short one.")], key=repr)
    assert drop_repeated_units(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    other = "A completely different second text that should stay whole and intact, whatever row stands beside it in the table."
    rows = [(0, f"Start. {S}"), (1, f"Then. {S} End."), (1, other), (1, other), (7, f"{S} {S}"), (7, "")]
    assert dedup(spark, rows) == sorted([(0, f"Start. {S}", 0, 0), (1, "Then. End.", len(S) + 1, 1), (1, other, 0, 0), (1, other, 0, 0), (7, "", 2 * len(S) + 1, 1), (7, "", 0, 0)], key=repr)
    # two different texts of one id with an equal passage: it stays in one of them
    two = dedup(spark, [(3, f"One. {S}"), (3, f"Two. {S}")])
    assert sorted(r[3] for r in two) == [0, 1] and {len(r[1]) for r in two} == {4, 5 + len(S)}


@pytest.mark.parametrize("pattern", [SENTENCES, LINES, PARAGRAPHS])
def test_by_definition(spark, pattern):
    rng = random.Random(5)
    vocabulary = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 12))) + rng.choice([".", "!\n", "\n", "\n\n", ".  \n "]) for _ in range(60)]
    rows = [(k, "".join(rng.choice(vocabulary) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25))) or None) for k in range(120)]
    assert dedup(spark, rows, pattern=pattern) == by_definition(rows, pattern)


def test_documents_by_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert dedup(spark, rows) == by_definition(rows)


def test_long_texts_and_common_units(spark, monkeypatch):
    monkeypatch.setattr(tables, "MOST_HEAVY", 4)
    words = "".join(f"word {k} of the long text. " for k in range(40_000))
    rows = [(1, words), (2, "Before. " + words), *((k, f"Own words {k}. {S}") for k in range(10, 300))]
    got = {r[0]: r for r in dedup(spark, rows)}
    assert got[1][2] == 0 and got[2][1] == "Before. " and got[2][3] == 1
    assert got[10][2] == 0 and all(got[k][1] == f"Own words {k}." for k in range(11, 300))


def test_passages_of_short_units(spark):
    verse = "".join(f"line {k} of it\n" for k in range(20))
    chinese = "我们今天在这里学习如何处理大量的文件以及怎样把重复的段落从很多文本里面去掉并且保留第一次出现\n"
    rows = [
        (1, f"A start of its own.\n{verse}"),
        (2, f"Other\nwords\n\n{verse}The end comes here and it is long enough.\n"),
        (3, verse[13:]),
        (4, "la la\n" * 30),
        (5, f"Yes\n{chinese}"),
        (6, f"No\n{chinese}Wait\n"),
        (7, "Too short.\n"),
        (8, "Too short.\n"),
    ]
    got = {r[0]: r[1] for r in dedup(spark, rows)}
    assert got == {1: rows[0][1], 2: "Other\nwords\n\nThe end comes here and it is long enough.\n", 3: "", 4: "la la\n", 5: rows[4][1], 6: "No\nWait\n", 7: rows[6][1], 8: rows[7][1]}
