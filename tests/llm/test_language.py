import zlib

import numpy as np

from pagemill.llm import language as L


def test_gradient():
    r = np.random.default_rng(0)
    w = L.initial(3)
    texts, mask, label = r.integers(0, 256, (6, 4)), np.ones((6, 4)), np.array([0, 1, 2, 1])
    mask[4:, 1] = 0
    _, grad = L.loss_and_gradient(w, texts, mask, label)
    for k, v in w.items():
        for _ in range(4):
            i = tuple(r.integers(s) for s in v.shape) if k != "embed" else (r.integers(L.EMBED), texts[r.integers(6), r.integers(4)])
            at = v[i]
            v[i] = at + 1e-5
            high = L.loss_and_gradient(w, texts, mask, label)[0]
            v[i] = at - 1e-5
            low = L.loss_and_gradient(w, texts, mask, label)[0]
            v[i] = at
            assert abs((high - low) / 2e-5 - grad[k][i]) < 1e-6


def test_reading_in_stretches_is_the_network():
    w = {k: v.astype(np.float32) for k, v in L.initial(3, 5).items()}
    texts = [b"abc", "é".encode() * 150, b"x" * 128, b"q" * 700]
    data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    p, votes = L.pooled(w, data, np.cumsum(lengths) - lengths, lengths)
    for k, t in enumerate(texts):
        total = np.zeros(3)
        for at in range(0, len(t), L.STRETCH):
            part = np.frombuffer(t[at : at + L.STRETCH], np.uint8)
            states = {}
            for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
                h, states[d] = np.zeros((L.HIDDEN, 1)), {}
                for s in order:
                    h = L._step(w[f"gates_{d}"], w[f"new_{d}"], h, w["embed"][:, part[s : s + 1]])[0]
                    states[d][s] = h
            for s in range(len(part)):
                z = w["out"] @ np.concatenate((states["f"][s], states["b"][s], [[1.0]]))
                total += (np.exp(z - z.max()) / np.exp(z - z.max()).sum())[:, 0]
        assert np.allclose(p[:, k], total / len(t), atol=1e-4)
    assert np.allclose(votes.sum(axis=0), 1)


def test_reading_works_on_bytes_alone(monkeypatch):
    w = {k: v.astype(np.float32) for k, v in L.initial(3, 5).items()}
    cost = {"exp": 0, "tanh": 0}
    plain = {k: getattr(np, k) for k in cost}
    for name in cost:
        monkeypatch.setattr(np, name, lambda x, out=None, name=name: (cost.__setitem__(name, cost[name] + x.size), plain[name](x, out=out))[1])
    for lengths in (np.full(1000, 128), np.array([128] + [1] * 999)):
        cost |= {"exp": 0, "tanh": 0}
        L.pooled(w, np.full(lengths.sum(), 97, np.uint8), np.cumsum(lengths) - lengths, lengths)
        # three values a unit, in two directions; labels are computed for some places at once. tanh takes as long as two exp
        assert cost["exp"] + 2 * cost["tanh"] <= lengths.sum() * 2 * 3 * L.HIDDEN + 3 * (lengths.sum() + L.AT_ONCE * len(lengths))


def test_reading_saturated_and_ragged_texts_is_the_network():
    w = {k: (v * (40 if k != "out" else 1)).astype(np.float32) for k, v in L.initial(3, 5).items()}
    r = np.random.default_rng(2)
    lengths = np.array([1, 200, 7, 128, 8, 9, 127, 1, 64])
    texts = [r.integers(0, 256, n).astype(np.uint8) for n in lengths]
    p, votes = L.pooled(w, np.concatenate(texts), np.cumsum(lengths) - lengths, lengths)
    for k, text in enumerate(texts):
        alone, own = L.pooled(w, text, np.array([0]), lengths[k : k + 1])
        assert np.allclose(p[:, k], alone[:, 0], atol=1e-6) and np.allclose(votes[:, k], own[:, 0])
        want = np.zeros(3)
        for at in range(0, len(text), L.STRETCH):
            part = text[at : at + L.STRETCH]
            states = {d: {} for d in "fb"}
            for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
                h = np.zeros((L.HIDDEN, 1))
                for t in order:
                    h = states[d][t] = L._step(w[f"gates_{d}"], w[f"new_{d}"], h, w["embed"][:, part[t : t + 1]])[0]
            for t in range(len(part)):
                z = w["out"] @ np.concatenate((states["f"][t], states["b"][t], [[1.0]]))
                want += (np.exp(z - z.max()) / np.exp(z - z.max()).sum())[:, 0]
        assert np.allclose(p[:, k], want / len(text), atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(10**6, None, "en", "a"), (10**6 + 1, "12 !", "en", "a"), (10**6 + 2, "", None, None), (None, "Und der die", "de", "x"), (1, "x" * 300_000, "qq", "a")], docs.schema)
    got = L.identify_language(docs.unionByName(odd).withColumnRenamed("source", "score")).collect()
    assert len(got) == 1005
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (10**6, 10**6 + 1, 10**6 + 2))
    tested = [r for r in got if r.held_out and r.doc_id < 10**6]
    assert np.mean([r.lang == r.lang_pred for r in tested]) > 0.97


def test_many_rows_of_one_id_and_many_languages(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 3)
    rows = [(7, f"der die und das {k} " * 9, "de") for k in range(3000)] + [(100 + k, f"the and of that {k} " * 9, "en") for k in range(60)] + [(500 + k, f"le la les une {k} " * 9, "fr") for k in range(50)]
    rows += [(900 + k, "rare words", f"l{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    a, b = (L.sample_windows(x, F.lit(True), "doc_id", "text", "lang", docs_a_language=20) for x in (df, df.repartition(7)))
    assert a == b and a[2] == ["de", "en", "fr"]
    assert all(0 < a[1].count(k) <= 40 * L.WINDOWS_A_DOC for k in range(3))


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string, lang string"
    assert L.identify_language(spark.createDataFrame([], schema)).collect() == []
    (r,) = L.identify_language(spark.createDataFrame([(1, "words", None)], schema)).collect()
    assert (r.lang_pred, r.score) == ("und", 0.0)
