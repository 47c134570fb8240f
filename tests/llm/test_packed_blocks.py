import random

import numpy as np

from pagemill.llm.ngram_join import _overlaps, _packed, _unpacked, near_texts
from test_ngram_join import brute, shingles


def test_packed_blocks_hold_their_sets(spark):
    """Blocks of near copies are packed as bits, blocks of different texts as places; either gives the intersections of its sets."""
    r = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    near = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(70)]
    far = [" ".join(f"v{r.randrange(9000)}" for _ in range(r.randint(0, 90))) + " w1 w2 w3 w4 w5 w6" for _ in range(70)]
    rows = [(1, own, 2, 100 * own + k, 1, [1], t) for own, texts in enumerate((near, far)) for k, t in enumerate(texts)]
    told = sorted((x.asDict() for x in _packed(spark.createDataFrame(rows, "cell long, own int, blocks int, node long, weight long, cells array<long>, text string")).collect()), key=lambda x: x["own"])
    assert [x["dense"] for x in told] == [True, False] and [len(x["nodes"]) for x in told] == [70, 70]
    one, two = map(_unpacked, told)
    text = {x[3]: shingles(x[6]) for x in rows}
    for a, b, p, q in ((told[0], told[1], one, two), (told[0], told[0], one, one), (told[1], told[1], two, two)):
        want = np.array([[len(text[i] & text[j]) for j in b["nodes"]] for i in a["nodes"]])
        assert (_overlaps(p, q, 70, 70, width=37) == want).all()


def test_several_large_cells(spark):
    r = random.Random(8)
    rows = []
    for g in range(2):
        group = [f"{'ab'[g]}{r.randrange(10**6)}" for _ in range(90)]
        for k in range(600):
            near = group.copy()
            near[r.randrange(90)] = f"z{k}"
            rows.append((1000 * g + k, " ".join(near)))
    got = {x.doc_id: (x.class_id, x.n_links) for x in near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(dict(rows))
