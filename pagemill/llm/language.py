"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import free_name

#: Sizes of a byte's embedding and of the state in each direction.
EMBED, HIDDEN = 8, 16
#: Bytes that the network reads from a fresh state; a text is such stretches one after another, to its end.
STRETCH = 128
#: Stretches that are read side by side.
SIDE_BY_SIDE = 1024
#: Places whose labels are computed at once.
AT_ONCE = 8
#: The sample to learn from: so many documents of each language, so many windows of each, so many characters of a window.
DOCS_A_LANGUAGE, WINDOWS_A_DOC, WINDOW_CHARS = 400, 3, 96
#: Languages that are learnt, the most frequent ones.
MOST_LANGUAGES = 256
#: Training: stretches in a step, bytes of each, steps, and Adam's rate.
BATCH, LEARN_BYTES, STEPS, RATE = 128, 64, 160, 0.02
#: Returned for a text without any letter.
UNDETERMINED = "und"

Weights = dict[str, np.ndarray]


def initial(classes: int, seed: int = 1) -> Weights:
    r = np.random.default_rng(seed)
    w: Weights = {"embed": r.normal(0, 0.5, (EMBED, 256))}
    for d in "fb":
        w[f"gates_{d}"] = r.normal(0, 0.3, (2 * HIDDEN, HIDDEN + EMBED + 1))
        w[f"new_{d}"] = r.normal(0, 0.3, (HIDDEN, HIDDEN + EMBED + 1))
    w["out"] = r.normal(0, 0.1, (classes, 2 * HIDDEN + 1))
    return {k: v.astype(np.float64) for k, v in w.items()}


def _step(gates: np.ndarray, new: np.ndarray, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of a gated recurrent unit: the next state, and what backpropagation needs of it."""
    one = np.ones((1, h.shape[1]), h.dtype)
    into = np.concatenate((h, x, one))
    rz = 0.5 * np.tanh(0.5 * (gates @ into)) + 0.5
    r, z = rz[:HIDDEN], rz[HIDDEN:]
    reset = np.concatenate((r * h, x, one))
    n = np.tanh(new @ reset)
    return h + z * (n - h), into, reset, rz, n


def loss_and_gradient(w: Weights, texts: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, Weights]:
    """Mean cross-entropy of every position's label, and its gradient. texts and mask: (steps, batch); label: (batch)."""
    steps, batch = texts.shape
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    x = w["embed"][:, texts]  # embed, steps, batch
    seen, states = {}, {}
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        h = np.zeros((HIDDEN, batch))
        seen[d], states[d] = [None] * steps, [None] * steps
        for t in order:
            before = h
            h, *rest = _step(w[f"gates_{d}"], w[f"new_{d}"], h, x[:, t])
            h = h * mask[t]
            seen[d][t], states[d][t] = (before, *rest), h
    both = np.concatenate((np.array(states["f"]), np.array(states["b"]), np.ones((steps, 1, batch))), axis=1)
    logits = np.einsum("ch,shb->scb", w["out"], both)
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    total = mask.sum()
    right = np.arange(p.shape[1])[:, None] == label[None]
    loss = -(np.log(np.maximum((p * right).sum(axis=1), 1e-30)) * mask).sum() / total
    dlogits = (p - right) * mask[:, None] / total
    grad["out"] += np.einsum("scb,shb->ch", dlogits, both)
    dboth = np.einsum("ch,scb->shb", w["out"], dlogits)
    dx = np.zeros_like(x)
    for d, order, at in (("f", range(steps - 1, -1, -1), 0), ("b", range(steps), HIDDEN)):
        dh = np.zeros((HIDDEN, batch))
        for t in order:
            before, into, reset, rz, n = seen[d][t]
            dh = (dh + dboth[t, at : at + HIDDEN]) * mask[t]
            r, z = rz[:HIDDEN], rz[HIDDEN:]
            dn = dh * z * (1 - n * n)
            dreset = w[f"new_{d}"].T @ dn
            drz = np.concatenate((dreset[:HIDDEN] * before, dh * (n - before))) * rz * (1 - rz)
            dinto = w[f"gates_{d}"].T @ drz
            grad[f"new_{d}"] += dn @ reset.T
            grad[f"gates_{d}"] += drz @ into.T
            dx[:, t] += dreset[HIDDEN:-1] + dinto[HIDDEN:-1]
            dh = dh * (1 - z) + dreset[:HIDDEN] * r + dinto[:HIDDEN]
    for e in range(EMBED):
        grad["embed"][e] = np.bincount(texts.ravel(), dx[e].ravel(), minlength=256)
    return loss, grad


def train(windows: list[bytes], labels: list[int], classes: int, steps: int = STEPS, seed: int = 1) -> Weights:
    """Weights learnt by Adam from windows of text, each class drawn equally often."""
    r = np.random.default_rng(seed)
    w = initial(classes, seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    of = [[i for i, x in enumerate(labels) if x == c] for c in range(classes)]
    for step in range(1, steps + 1):
        label = np.array([c % classes for c in range(BATCH)])
        texts, mask = np.zeros((LEARN_BYTES, BATCH), np.int64), np.zeros((LEARN_BYTES, BATCH))
        for b, c in enumerate(label):
            text = windows[of[c][r.integers(len(of[c]))]]
            begin = r.integers(max(1, len(text) - LEARN_BYTES + 1))
            own = np.frombuffer(text[begin : begin + LEARN_BYTES], np.uint8)
            texts[: len(own), b], mask[: len(own), b] = own, 1
        _, grad = loss_and_gradient(w, texts, mask, label)
        norm = max(1.0, np.sqrt(sum((g * g).sum() for g in grad.values())))
        for k, g in grad.items():
            first[k] += 0.1 * (g / norm - first[k])
            second[k] += 0.01 * ((g / norm) ** 2 - second[k])
            w[k] -= RATE * (1 - 0.9 * (step / steps)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in w.items()}


def pooled(w: Weights, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean class probabilities over all positions of each text, and the share of positions labelled with each class.

    Texts lie in data as bytes. Each is read in stretches; stretches are read side by side, the longest first, and a batch
    ends where its longest stretch does.
    """
    classes = w["out"].shape[0]
    pieces = -(-lengths // STRETCH)
    text = np.repeat(np.arange(len(lengths)), pieces)
    ordinal = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[text] + ordinal * STRETCH
    length = np.minimum(lengths[text] - ordinal * STRETCH, STRETCH)
    order = np.argsort(-length, kind="stable")
    sums, votes = np.zeros((classes, len(text))), np.zeros((classes, len(text)))
    for k in range(0, len(order), SIDE_BY_SIDE):
        chosen = order[k : k + SIDE_BY_SIDE]
        sums[:, chosen], votes[:, chosen] = _read(w, data, begin[chosen], length[chosen])
    total = np.zeros((2, classes, len(lengths)))
    for c in range(classes):
        total[0, c] = np.bincount(text, sums[c], minlength=len(lengths))
        total[1, c] = np.bincount(text, votes[c], minlength=len(lengths))
    total /= np.maximum(lengths, 1)
    return total[0], total[1]


def _read(w: Weights, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the positions of each stretch, the longest first: class probabilities, and labels of each class."""
    steps, n, classes = int(length[0]), len(begin), w["out"].shape[0]
    live = np.searchsorted(-length, -np.arange(steps)).tolist()  # at each place, so many stretches go on
    texts = data[np.minimum(begin[None] + np.arange(steps)[:, None], len(data) - 1)]
    rows = texts[:, None] + (256 * np.arange(3, dtype=np.int16))[:, None]
    forth, back = np.zeros((steps, n, HIDDEN), np.float32), np.zeros((min(steps, AT_ONCE), n, HIDDEN), np.float32)
    work = np.empty((2, 2 * n * HIDDEN), np.float32)
    sums, votes = np.zeros((classes, n), np.float32), np.zeros((classes, n), np.float32)
    out_f, out_b = (np.ascontiguousarray(w["out"][:, k : k + HIDDEN].T) for k in (0, HIDDEN))
    read_f, read_b = (_by_byte(w, d) for d in "fb")
    h = np.zeros((n, HIDDEN), np.float32)
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is the limit
        _advance(*read_f, rows, live, range(steps), h, forth, work)
        for first in range((steps - 1) // AT_ONCE * AT_ONCE, -1, -AT_ONCE):
            part = slice(first, min(first + AT_ONCE, steps))
            k, m = part.stop - first, live[first]
            h = _advance(*read_b, rows[part], live[part], range(k - 1, -1, -1), h, back, work).copy()
            logits = forth[part, :m].reshape(-1, HIDDEN) @ out_f
            logits += back[:k, :m].reshape(-1, HIDDEN) @ out_b
            p = np.ascontiguousarray(logits.T)
            p += w["out"][:, -1:]
            p -= p.max(axis=0)
            best = (p == 0).reshape(classes, k, m)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            p = p.reshape(classes, k, m)
            if live[part.stop - 1] < m:
                there = length[:m] > np.arange(first, part.stop)[:, None]
                p *= there
                best &= there
            sums[:, :m] += p.sum(axis=1)
            votes[:, :m] += best.sum(axis=1)
    return sums, votes


def _by_byte(w: Weights, d: str) -> tuple[np.ndarray, np.ndarray]:
    """A direction's weights for _advance: what each byte and the bias add to reset, update and new state (3 * 256, hidden), and the
    factors of the state (3, hidden, hidden). Of opposite sign, those of the new state doubled, as exp needs them."""
    signed = np.concatenate((-w[f"gates_{d}"], -2 * w[f"new_{d}"]))
    own = signed[:, HIDDEN:-1] @ w["embed"] + signed[:, -1:]
    by_byte = own.reshape(3, HIDDEN, 256).transpose(0, 2, 1).reshape(3 * 256, HIDDEN)
    return by_byte, np.ascontiguousarray(signed[:, :HIDDEN].reshape(3, HIDDEN, HIDDEN).transpose(0, 2, 1))


def _advance(by_byte: np.ndarray, factors: np.ndarray, rows: np.ndarray, live: list[int], order: range, h: np.ndarray, states: np.ndarray, work: np.ndarray) -> np.ndarray:
    """Writes the states of a direction at the places in order, from h before them, and gives the last one.

    The same unit as _step's, by 1 / (1 + exp(-x)) for the gates and 2 / (1 + exp(-2 x)) - 1 for tanh, which takes about twice as long
    as exp. Stretches that have ended are at the end of each place and left out; their states stay as they are, zero.
    """
    one, two, width = np.float32(1), np.float32(2), -1
    for t in order:
        if live[t] != width:
            width = live[t]
            seen, gates = (x[: 2 * width * HIDDEN].reshape(2, width, HIDDEN) for x in work)
            r, z = gates
        before, new = h[:width], states[t, :width]
        np.take(by_byte, rows[t, :2, :width], axis=0, out=seen, mode="clip")
        np.matmul(before, factors[:2], out=gates)
        gates += seen
        np.exp(gates, out=gates)
        gates += one
        np.divide(before, r, out=r)
        np.matmul(r, factors[2], out=new)
        np.take(by_byte, rows[t, 2, :width], axis=0, out=r, mode="clip")
        new += r
        np.exp(new, out=new)
        new += one
        np.divide(two, new, out=new)
        new -= one
        new -= before
        new /= z
        new += before
        h = states[t]
    return h


def sample_windows(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, docs_a_language: int = DOCS_A_LANGUAGE) -> tuple[list[bytes], list[int], list[str]]:
    """Windows of text to learn from, their labels and the languages in order. Chosen by a hash of id and text, about docs_a_language
    documents of each language and at most twice as many, those of the least hashes, of MOST_LANGUAGES languages at most: that bounds what comes to the driver."""
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return [], [], []
    share = docs.sparkSession.createDataFrame([(k, docs_a_language / v) for k, v in counts.items()], "l string, share double")
    known = known.join(F.broadcast(share), F.col("lang") == F.col("l")).withColumn("h", F.xxhash64("id", "text"))
    places = F.expr(
        f"transform(sequence(1, {WINDOWS_A_DOC}), k -> substring(text, cast(1 + pmod(xxhash64(h, k), greatest(1, length(text) - {WINDOW_CHARS})) as int), {WINDOW_CHARS}))"
    )

    def least(some: DataFrame) -> list:
        ranked = some.select("lang", "h", places.alias("windows")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
        return ranked.where(F.col("rank") <= 2 * docs_a_language).select("lang", "h", "windows").collect()

    rows = least(known.where(F.pmod("h", F.lit(1 << 40)) < F.col("share") * (1 << 40)))
    missed = sorted(counts.keys() - {r["lang"] for r in rows})
    if missed:  # languages of few different rows, all of whose hashes are above their share
        rows += least(known.where(F.col("lang").isin(missed)))
    languages = sorted({r["lang"] for r in rows})
    rows.sort(key=lambda r: (r["lang"], r["h"], r["windows"]))
    pairs = [(x.encode(), languages.index(r["lang"])) for r in rows for x in r["windows"] if x]
    return [p[0] for p in pairs], [p[1] for p in pairs], languages


def predictor(w: Weights | None, languages: list[str]):
    """An Arrow UDF: text and whether it has a letter, to struct<lang, score, share>."""
    kind = pa.struct([pa.field("lang", pa.string()), pa.field("score", pa.float64()), pa.field("share", pa.float64())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, letter in batches:
            text = text.cast(pa.large_binary())
            n = len(text)
            lang, score, share = [UNDETERMINED] * n, np.zeros(n), np.zeros(n)
            use = np.flatnonzero(letter.to_numpy(zero_copy_only=False).astype(bool)) if w else np.zeros(0, int)
            if len(use):
                offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
                data = np.frombuffer(text.buffers()[2], np.uint8)
                p, votes = pooled(w, data, offsets[use], offsets[use + 1] - offsets[use])
                best = p.argmax(axis=0)
                score[use] = np.clip(p[best, np.arange(len(use))], 0, 1)
                share[use] = np.clip(votes[best, np.arange(len(use))], 0, 1)
                for i, b in zip(use.tolist(), best.tolist(), strict=True):
                    lang[i] = languages[b]
            yield pa.StructArray.from_arrays([pa.array(lang), pa.array(score), pa.array(share)], fields=list(kind))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<lang:string,score:double,share:double>")


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with held_out, lang_pred, score and label_share: the predicted language, its pooled probability and the share of
    positions labelled with it.

    The network learns from documents with a language whose crc32(id as text) mod 4 is not 2; held_out says that it is 2. A document
    with a null id is neither. Every byte of the text counts; both directions begin anew every STRETCH bytes, which may cut a character, so
    memory doesn't grow with the text; language, source and id have no part in a prediction. A text that is
    null or has no letter is 'und' with score 0, and so is every text if nothing can be learnt. Of more than MOST_LANGUAGES languages the
    rarest aren't learnt, and so never predicted. Repeated rows are predicted
    alike. Columns of docs that have the name of a result are replaced by it, but a result may not be called like lang_col.
    """
    fold = F.crc32(F.col(id_col).cast("string")) % 4
    windows, labels, languages = sample_windows(docs, fold != 2, id_col, text_col, lang_col)
    w = train(windows, labels, len(languages)) if windows else None
    found = free_name(docs, "found_")
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    told = docs.drop("held_out", "lang_pred", "score", "label_share").withColumn(found, predictor(w, languages)(F.col(text_col), letter))
    return told.withColumns(
        {"held_out": F.coalesce(fold == 2, F.lit(False)), "lang_pred": F.col(found)["lang"], "score": F.col(found)["score"], "label_share": F.col(found)["share"]}
    ).drop(found)
