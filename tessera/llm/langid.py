"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on windows of sampled documents. Every byte
position gets language probabilities from the states that have read up to it from both
sides; a document's probabilities are the means over all its positions. Long texts are read
in windows that overlap by ``MARGIN`` bytes on each side, so each position has context and
is counted once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .common import arrow_map, fold

CORE, MARGIN, BATCH = 448, 32, 512
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """``gates[d]``: input table (256, 3h), recurrent weights (h, 3h); output (2h, k) and bias."""

    langs: tuple[str, ...]
    tables: tuple[np.ndarray, np.ndarray]
    recur: tuple[np.ndarray, np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def _forward(table: np.ndarray, u: np.ndarray, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (time, rows, h) of one direction. x: bytes (time, rows)."""
    h = u.shape[0]
    s = np.zeros((x.shape[1], h), np.float32)
    states, trace = np.empty((x.shape[0], x.shape[1], h), np.float32), []
    for t in range(x.shape[0]):
        a = table[x[t]]
        r = s @ u
        zr = a[:, : 2 * h] + r[:, : 2 * h]
        np.multiply(zr, 0.5, out=zr)
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, g = zr[:, :h], zr[:, h:]
        rn = r[:, 2 * h :]
        n = np.tanh(a[:, 2 * h :] + g * rn)
        new = n + z * (s - n)
        if keep:
            trace.append((s, z, g, rn, n))
        s = states[t] = new
    return states, trace


def _backward(u: np.ndarray, x: np.ndarray, trace: list, ds: np.ndarray, d_table: np.ndarray, d_u: np.ndarray) -> None:
    """Backpropagation through time of one direction; ds: gradients of the states."""
    h = u.shape[0]
    carry = np.zeros(ds.shape[1:], np.float32)
    for t in range(x.shape[0] - 1, -1, -1):
        s, z, g, rn, n = trace[t]
        d = ds[t] + carry
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (s - n) * z * (1 - z)
        dg = dn * rn * g * (1 - g)
        da = np.concatenate([dz, dg, dn], 1)
        dr = np.concatenate([dz, dg, dn * g], 1)
        np.add.at(d_table, x[t], da)
        d_u += s.T @ dr
        carry = d * z + dr @ u.T


def fit(windows: np.ndarray, labels: np.ndarray, langs: tuple[str, ...], hidden: int = 8, steps: int = 250, batch: int = 128, rate: float = 0.02, seed: int = 0) -> Model:
    """Train on byte windows (rows, time; zeros behind a short text do not count) with a language index each."""
    rng = np.random.default_rng(seed)
    k = len(langs)
    p = [rng.normal(0, 0.3, (256, 3 * hidden)), rng.normal(0, 0.3, (256, 3 * hidden)), rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)), rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)), rng.normal(0, 0.3, (2 * hidden, k)), np.zeros(k)]
    p = [a.astype(np.float32) for a in p]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(windows), batch)
        x, y = windows[rows].T, labels[rows]
        fwd, tf = _forward(p[0], p[2], x, True)
        bwd, tb = _forward(p[1], p[3], x[::-1], True)
        both = np.concatenate([fwd, bwd[::-1]], 2)
        logits = both @ p[4] + p[5]
        logits -= logits.max(2, keepdims=True)
        e = np.exp(logits)
        d = e / e.sum(2, keepdims=True)
        d[:, np.arange(batch), y] -= 1
        d *= (x > 0)[:, :, None] / max(1, int((x > 0).sum()))
        g = [np.zeros_like(a) for a in p]
        g[4] = both.reshape(-1, 2 * hidden).T @ d.reshape(-1, k)
        g[5] = d.sum((0, 1))
        ds = d @ p[4].T
        _backward(p[2], x, tf, ds[:, :, :hidden], g[0], g[2])
        _backward(p[3], x[::-1], tb, ds[::-1, :, hidden:], g[1], g[3])
        now = rate * (1 - step / (steps + 1))
        for i, a in enumerate(g):
            m[i] = 0.9 * m[i] + 0.1 * a
            v[i] = 0.99 * v[i] + 0.01 * a * a
            p[i] -= (now * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Model(langs, (p[0], p[1]), (p[2], p[3]), p[4], p[5])


def positions(model: Model, x: np.ndarray) -> np.ndarray:
    """Language probabilities at every position of windows (time, rows)."""
    fwd, _ = _forward(model.tables[0], model.recur[0], x, False)
    bwd, _ = _forward(model.tables[1], model.recur[1], x[::-1], False)
    h = fwd.shape[2]
    logits = fwd @ model.out[:h] + bwd[::-1] @ model.out[h:] + model.bias
    np.exp(np.clip(logits, -30, 30, out=logits), out=logits)
    logits /= logits.sum(2, keepdims=True)
    return logits


def _windows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first byte of the core) of every window over all rows."""
    size = np.diff(offs)
    count = -(-size // CORE)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, offs[row] + nth * CORE


def document_probabilities(model: Model, column: pa.Array) -> np.ndarray:
    """Mean position probabilities of each row; rows of no bytes get zeros."""
    buf, offs = T.utf8(column)
    row, at = _windows(buf, offs)
    k = len(model.langs)
    total = np.zeros((len(column), k))
    span = np.arange(-MARGIN, CORE + MARGIN)
    for a in range(0, len(row), BATCH):
        r, s = row[a : a + BATCH], at[a : a + BATCH]
        idx = s[None, :] + span[:, None]
        inside = (idx >= offs[r][None, :]) & (idx < offs[r + 1][None, :])
        x = np.where(inside, buf[np.clip(idx, 0, len(buf) - 1)], 0)
        p = positions(model, x)[MARGIN : MARGIN + CORE]
        p *= inside[MARGIN : MARGIN + CORE, :, None]
        np.add.at(total, r, p.sum(0))
    return total / np.maximum(np.diff(offs), 1)[:, None]


def train(docs: DataFrame, max_rows: int = 4000, window: int = 96, least: int = 200, tries: int = 4, steps: int = 400, aside: int = 1000) -> Model:
    """Fit on one window from each of about ``max_rows`` training documents (by hashed id).

    Languages share them as the fold does, so the network learns how common each is, but a
    rare one gets ``least`` windows, or all its documents if they are fewer; texts of any length
    with a letter count. A fit can end badly by its random start: of ``tries`` fits that one is
    taken whose loss is least on ``aside`` stretches of 2,000 characters of a fifth of the
    training documents, which no fit sees. Languages of ``least`` documents or fewer set none aside.
    """
    known = docs.where(fold(F.col("doc_id"), 4) != 2).where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
    known = known.select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string"), F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)).alias("_h"))
    count = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(count))
    if not langs:
        return Model((), (np.zeros((256, 3), np.float32),) * 2, (np.zeros((1, 3), np.float32),) * 2, np.zeros((2, 0), np.float32), np.zeros(0, np.float32))
    every = sum(count.values())
    each = {c: max(least, max_rows * count[c] // every) for c in langs}

    def of_lang(value) -> Column:
        return F.create_map(*[F.lit(x) for c in langs for x in (c, value(c))])[F.col("lang")]

    def stretch(df: DataFrame, size: int) -> DataFrame:
        at = F.floor(F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - size + 1, F.lit(1)))).cast("int") + 1
        return df.select("doc_id", "lang", "_h", F.substr("text", at, F.lit(size)).alias("text"))

    held = (F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(5)) == 0) & of_lang(lambda c: count[c] > least)
    most = of_lang(lambda c: (1 << 30) if count[c] <= 4 * each[c] else int((1 << 30) * 2 * each[c] / count[c]))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "text"))
    got = stretch(known.where(~F.coalesce(held, F.lit(False))).where(F.col("_h") < most), window).withColumn("_nth", nth).where(F.col("_nth") <= of_lang(lambda c: each[c]))
    got = got.toPandas().sort_values(["doc_id", "text"], kind="stable")
    near = known.where(held) if every <= 20 * aside else known.where(held).where(F.col("_h") < int((1 << 30) * 10 * aside / every))
    tested = stretch(near, 2000).orderBy("_h", "doc_id", "text").limit(aside).toPandas()
    x = np.zeros((len(got), window), np.uint8)
    for i, t in enumerate(got.text):
        b = np.frombuffer(t.encode()[:window], np.uint8)
        x[i, : len(b)] = b
    y = np.array([langs.index(c) for c in got.lang])
    fits = [fit(x, y, langs, steps=steps, seed=k) for k in range(tries if len(tested) else 1)]
    if len(fits) == 1:
        return fits[0]
    texts, true = pa.array(tested.text, pa.string()), np.array([langs.index(c) for c in tested.lang])

    def loss(model: Model) -> float:
        p = document_probabilities(model, texts)[np.arange(len(true)), true]
        return float(-np.log(np.maximum(p, 1e-9)).mean())

    return min(fits, key=loss)


def _predict_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            has = np.array([t is not None and bool(_LETTER.search(t)) for t in texts.to_pylist()], bool)
            if model.langs:
                p = document_probabilities(model, texts)
                best = p.argmax(1)
                lang = [model.langs[b] if ok else "und" for b, ok in zip(best, has, strict=True)]
                score = np.where(has, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            else:
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Language of every whole text, with the probability pooled over its positions.

    Null texts and texts without a letter (\\p{L}): ``und`` with score 0; so is all text if
    nothing could be learned. Equal probabilities: the first language by name. A very long
    text goes in windows, each byte of it counted once. One row per input row, repeated ones
    too; extra columns are not carried. Empty table: no rows.
    """
    out = arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _predict_batches(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
