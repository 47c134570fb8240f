import random

import pytest
from test_repeats import words

from pagemill.llm import repeats
from pagemill.llm.repeats import LENGTH, maximal_repeats


def corpus():
    r = random.Random(4)
    passage, other = words(r, 700), words(r, 420)
    rows = [(k, words(r, r.randint(0, 200)) + passage[r.randint(0, 150) : r.randint(400, 700)] + words(r, r.randint(0, 150))) for k in range(25)]
    rows += [(100 + k, words(r, 50) + other + passage[:230] + words(r, 30)) for k in range(6)]
    rows += [(200, other), (201, other), (202, "z" + other + "z" + other), (203, "x" * 700), (204, words(r, 3000)), (205, None), (206, "")]
    return rows


@pytest.mark.parametrize("hot", [65536, 6])
def test_groups_hold_all_occurrences_and_are_maximal(spark, hot):
    rows = corpus()
    data = {i: (t or "").encode() for i, t in rows}
    told = maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    groups = {}
    for r in told:
        groups.setdefault((r.group, r.length), []).append((r.id, r.start))
    assert len(groups) > 20 and all(len(own) > 1 and n >= LENGTH for (_, n), own in groups.items())
    for (_, n), own in groups.items():
        strings = {data[i][s : s + n] for i, s in own}
        assert len(strings) == 1
        [string] = strings
        every = {(i, s) for i, b in data.items() for s in range(len(b) - n + 1) if b.startswith(string, s)}
        assert len(own) == len(set(own)) and set(own) == every
        # it can't go on to either side
        before = {data[i][s - 1] if s else -1 - k for k, (i, s) in enumerate(own)}
        after = {data[i][s + n] if s + n < len(data[i]) else -1 - k for k, (i, s) in enumerate(own)}
        assert len(before) > 1 and len(after) > 1
    # each string of LENGTH bytes that occurs again lies within a repeat, wherever it occurs
    seen = {}
    for i, b in data.items():
        for s in range(len(b) - LENGTH + 1):
            seen.setdefault(b[s : s + LENGTH], []).append((i, s))
    marks = {i: bytearray(len(b)) for i, b in data.items()}
    for (_, n), own in groups.items():
        for i, s in own:
            marks[i][s : s + n] = b"\1" * n
    want = {i: bytearray(len(b)) for i, b in data.items()}
    for own in seen.values():
        for i, s in own if len(own) > 1 else ():
            want[i][s : s + LENGTH] = b"\1" * LENGTH
    assert marks == want


@pytest.mark.parametrize("hot, first", [(65536, 16), (1, 1024)])
def test_a_long_passage_is_one_group(spark, monkeypatch, hot, first):
    monkeypatch.setattr(repeats, "FIRST_CHUNK", first)
    r = random.Random(8)
    passage, copy = words(r, 1500), words(r, 9000)
    rows = [(1, words(r, 300) + passage + words(r, 200)), (2, words(r, 90) + passage), (3, copy), (4, copy), (5, copy + "!"), (6, words(r, 500))]
    told = maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    groups = {}
    for x in told:
        groups.setdefault((x.group, x.length), set()).add((x.id, x.start))
    n, m = len(passage.encode()), len(copy.encode())
    at = {i: t.encode().index(passage.encode()) for i, t in rows[:2]}
    # at the edges a byte may be shared by chance
    [long] = [own for (_, k), own in groups.items() if n <= k < n + 8]
    assert {i for i, _ in long} == {1, 2} and all(at[i] - 8 < s <= at[i] for i, s in long)
    assert sorted(k for _, k in groups) == sorted([*(k for _, k in groups if n <= k < n + 8), m]) and len(groups) == 2
    assert groups[next(g for g in groups if g[1] == m)] == {(3, 0), (4, 0), (5, 0)}


def test_spans_of_a_periodic_text_are_joined_first(spark, monkeypatch):
    from test_repeats import brute, run

    rows = [(1, "ab" * 30_000), (2, "ab" * 150), (3, "x" * 500)]
    seen = []
    cut = repeats._joined
    monkeypatch.setattr(repeats, "_joined", lambda spans: seen.append(1) or cut(spans))
    got = run(spark, rows)
    assert seen and [r[2:4] for r in got] == [(60_000, 1), (300, 1), (500, 1)]
    assert run(spark, [(1, "ab" * 3000), (2, "ab" * 150)]) == brute([(1, "ab" * 3000), (2, "ab" * 150)])
