import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from pagemill.llm.packing import WINDOW_COST, candidates, cuts, pack, padding
from pagemill.llm.tokens import default_path, encoder

TEXTS = ["", "a", "<|endoftext|> x<|endoftext|>", "it's  a\n\n  test\t é 漢字 😀 ​\x00 \r\n  ", "a" * 3000, " " * 3000, "\n" * 2000 + "x", "12 %%%$$$ 'll. " * 900]


def test_ids_are_those_of_the_tokenizers_library():
    encode, _ = encoder(default_path())
    own = Tokenizer.from_file(default_path())
    for text in TEXTS:
        assert encode(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_long_white_space(spark):
    encode, _ = encoder(default_path())
    own = Tokenizer.from_file(default_path())
    n = 2_000_000
    for text in (" " * n, "\n" * n, "x" + " " * n + "y", "\t \n\r" * (n // 4) + "z", "a" + "\u3000\xa0 " * (n // 3), "\x1c" * 5000, " " * 4096 + "'s", "\n" * 4097 + "<|endoftext|>" + " " * 5000 + "12"):
        assert np.array_equal(encode(text), np.array(own.encode(text, add_special_tokens=False).ids, "<u4"))
    rows = pack(spark.createDataFrame([(1, " " * n + "end"), (2, "after")], "doc_id long, text string")).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == len(encode(" " * n + "end")) + 1


def test_cuts_cost_least():
    r = np.random.default_rng(3)
    for _ in range(60):
        n = int(r.integers(1, 260))
        ends = r.random(n) < 0.03
        ends[-1] = True
        places, costs = candidates(ends, r.random(n) < 0.25)
        if np.diff(places).max() > 64:
            continue
        best = [0.0] + [np.inf] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                if (length := int(places[j] - places[i])) <= 64:
                    best[j] = min(best[j], best[i] + padding(length, 64) + costs[j] + WINDOW_COST)
        found = cuts(places, costs, 64)
        cost = dict(zip(places.tolist(), costs.tolist(), strict=True))
        assert abs(sum(padding(b - a, 64) + cost[b] + WINDOW_COST for a, b in zip(found, found[1:])) - best[-1]) < 1e-6


def test_pieces_round_trip(spark):
    rng = random.Random(1)
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(20, None, None, None), (None, "no id", None, None), (3, TEXTS[3], "x", 1)]
    rows += [(100 + k, " ".join(rng.choice(["of", "the", "thing.", "Erin,"]) for _ in range(rng.randint(1, 900))), None, None) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, offset int").repartition(3)
    got = pack(df, with_ids=True).collect()
    encode, _ = encoder(default_path())
    want = sorted([*encode(t or "").tolist(), 0] for _, t, *_ in rows)
    sequences, docs = {}, {}
    for r in got:
        assert r.length == len(r.ids) > 0 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    # pieces of a document follow one another in the order of sequences, also where an id is repeated
    open_ = {}
    out = []
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        own = open_.setdefault((r.sequence_id >> 33, r.doc_id), [])
        assert r.start == len(own)
        own += r.ids
        if len(own) == r.doc_tokens:
            out.append(open_.pop((r.sequence_id >> 33, r.doc_id)))
    assert not open_ and sorted(out) == want
    total = sum(map(len, want))
    assert sum(padding(sum(r.length for r in p), 1024) for p in sequences.values()) < 0.05 * total
    assert docs == {}


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
