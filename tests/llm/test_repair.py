import hashlib
import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import repair
from pagemill.llm.repair import BLANK, CUT, DUPLICATE, SOUND, SYMBOLS, Runs, _times, advanced, costs, edits, power, repair_conversations


def legal(roles):
    roles = roles[1:] if roles[:1] == "s" and len(roles) > 1 else roles
    return len(roles) % 2 == 0 and roles == "ua" * (len(roles) // 2)


def brute(rows):
    """Every sequence of edits with up to two inserts before each row and at the end."""
    best = None
    gaps = [("",)] + [("u",), ("a",), ("u", "a"), ("a", "u")]
    ways = []
    for initial, fault in rows:
        own = [("D", 4, "")]
        if fault not in (BLANK, DUPLICATE):
            more = 3 if fault == CUT else 0
            own += [("K", more, initial or "?"), ("R", 3 + more, "u"), ("R", 3 + more, "a")]
        ways.append(own)
    for chosen in itertools.product(*[itertools.product(gaps, w) for w in ways]):
        for last in gaps:
            cost, audit, roles = 0, "", ""
            for gap, (letter, price, out) in [*chosen, (last, ("", 0, ""))]:
                added = [g for g in gap if g]
                cost += price + 3 * len(added)
                audit += "I" * len(added) + letter
                roles += "".join(added) + out
            if legal(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def ours(rows):
    runs = Runs(rows)
    assert [runs[k] for k in range(len(runs))] == [(k, len(list(g))) for k, g in itertools.groupby(rows)]
    cost, marks = costs(runs)
    return cost, "".join(e for e, _ in edits(runs, marks))


def viterbi(rows):
    """Forward, with the letters of every state: for longer conversations."""
    to = {"0": "u", "s": "u", "u": "a", "a": "u"}
    best = {"0": (0, "")}

    def inserts(b):
        out = dict(b)
        for q, (c, l) in b.items():
            for k in (1, 2):
                q = to[q]
                out[q] = min(out.get(q, (1 << 60, "")), (c + 3 * k, l + "I" * k))
        return out

    for initial, fault in rows:
        new = {}
        for q, (c, l) in inserts(best).items():
            put = lambda p, cost, letter: new.__setitem__(p, min(new.get(p, (1 << 60, "")), (c + cost, l + letter)))  # noqa: B023, E731
            put(q, 4, "D")
            if fault not in (BLANK, DUPLICATE):
                more = 3 if fault == CUT else 0
                if initial == to[q] or (q == "0" and initial == "s"):
                    put(initial, more, "K")
                put(to[q], 3 + more, "R")
        best = new
    return min(v for q, v in inserts(best).items() if q in "0a")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(SYMBOLS), max_size=3))
def test_all_edits(rows):
    assert ours(rows) == brute(rows) == viterbi(rows)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(SYMBOLS), st.integers(1, 9)), max_size=12))
def test_runs(parts):
    rows = [s for s, k in parts for _ in range(k)]
    assert ours(rows) == viterbi(rows)


def test_long_runs():
    for symbol in SYMBOLS:
        rows = [symbol] * 700 + [("u", SOUND), ("a", CUT)] * 40 + [symbol] * 131
        assert ours(rows) == viterbi(rows)


def test_marks_between_runs(monkeypatch):
    r = random.Random(6)
    for marked in (1, 2, 7):
        monkeypatch.setattr(repair, "MARKED", marked)
        for n in (0, 1, 6, 7, 8, 14, 100):
            rows = [r.choice(SYMBOLS) for _ in range(n)]
            assert ours(rows) == viterbi(rows)


def test_powers_are_products():
    for symbol in SYMBOLS:
        m = power(symbol, 0)
        for _ in range(7):
            m = _times(m, power(symbol, 0))
        assert m == power(symbol, 3)
        v = (5, 0, 9, 2)
        w = v
        for _ in range(13):
            w = advanced(symbol, 1, w)
        assert advanced(symbol, 13, v) == w


def plain(rows):
    """The result of one conversation's rows (turn, role, text), as the docstring has it."""
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, symbols, pairs = set(), [], 0
    for k, (_, role, text) in enumerate(rows):
        shown = text.encode().strip().decode()
        fault = BLANK if not shown else DUPLICATE if (role, text) in seen else SOUND if shown[-1] in ".!?" else CUT
        seen.add((role, text))
        symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault))
        pairs += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    cost, audit = viterbi(symbols)
    out, left, state = [], iter(rows), ""
    for letter in audit:
        _, role, text = (None, None, "") if letter == "I" else next(left)
        if letter != "D":
            name = role if letter == "K" else "assistant" if state == "u" else "user"
            state = name[0]
            out.append(f"{name}:{text}")
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults = [f for _, f in symbols]
    return (gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), pairs, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(), len(rows), len(out))


def test_conversations(spark):
    r = random.Random(3)
    texts = ["", " \n", "Yes.", "Yes.", "No", "é!", "Why?\t", None, "x" * 5000 + ".", "same", "end. "]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    convs = {c: [(r.choice([None, *range(9)]), r.choice(roles), r.choice(texts)) for _ in range(r.randrange(1, 14))] for c in range(150)}
    convs[None] = [(0, "user", "a."), (0, "user", "a."), (2, "assistant", "b.")]
    convs[900] = [(t, "user", f"t{t}.") for t in range(500)] + [(600, "system", "again")] * 300
    df = spark.createDataFrame([(c, *x) for c, rows in convs.items() for x in rows], "conv_id long, turn long, role string, text string")
    got = {x[0]: tuple(x)[1:] for x in repair_conversations(df.repartition(7)).collect()}
    assert got == {c: plain(rows) for c, rows in convs.items()}


def test_times_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.", 0, "x"), (2, 0, "user", "a.", 2, "x"), (2, 1, "assistant", "b.", None, "x"), (3, 5, "user", "q?", 1, "x")], "c long, turn long, role string, text string, times int, Conv_Id string")
    got = {x[0]: tuple(x)[1:] for x in repair_conversations(df, "c", times_col="times").collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), 0, 0)
    assert got == {1: nothing, 2: plain([(0, "user", "a."), (0, "user", "a."), (1, "assistant", "b.")]), 3: plain([(5, "user", "q?")])}
    assert got[2][6] == "KDK" and got[3][6] == "KI" and got[3][5] == 3
    assert repair_conversations(df.where("false"), "c").count() == 0


def test_one_shuffle(spark, sf):
    from pagemill.llm.queries import op13_conversation_repair

    plan = op13_conversation_repair(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
