"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; any other text is unlabelled, as unlabelled text
holds toxic text too. With class prior p, the risk of a scorer g is estimated as
``p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])`` (Kiryo et al., 2017). A few linear
classifiers over the presence of words (without the marks at their ends) are trained in numpy, each against its
own draw of the unlabelled texts, and their scores are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import arrow_map, fold, sample
from .components import smallest_reached

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
PROBE_BITS = 20


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights, the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _cores(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes) of a block's words without the marks at their ends; words of marks alone are left out."""
    at = np.arange(len(w.data) + 1)
    letter = _LETTER[w.data]
    after = np.minimum.accumulate(np.where(np.append(letter, True), at, len(w.data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(letter, at[1:], 0)) if len(letter) else at[:0]
    start, end = after[w.start], before[w.end - 1] if len(w.end) else w.end
    k = np.flatnonzero(start < end)
    return w.row[k], w.part(start[k], end[k])


def _row_features(column: pa.Array) -> list[np.ndarray]:
    """Distinct feature hashes of each row."""
    found = [_cores(w) for w in T.words(column)]
    if not found:
        return [np.zeros(0, np.uint64)] * len(column)
    rows, h = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    first = np.append(True, (rows[1:] != rows[:-1]) | (h[1:] != h[:-1]))
    rows, h = rows[first], h[first]
    return np.split(h, np.searchsorted(rows, np.arange(1, len(column))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 300, rate: float = 0.1, l1: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer that minimises the non-negative risk plus ``l1 * |w|``.

    Full-batch Adam with a falling rate; where the unlabelled part of the risk goes below
    zero, the step ascends it instead, as in the published algorithm.
    """
    rng = np.random.default_rng(seed)
    d, both = pos.shape[1], len(pos)
    x = np.vstack([pos, unl]).astype(np.float32)
    w, b = rng.normal(0, 1e-3, d), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        z = (x @ w.astype(np.float32)).astype(np.float64) + b
        g = _sigmoid(z)
        # logistic loss: l(z) = log(1 + e^-z) has slope g - 1, l(-z) has slope g
        part = np.logaddexp(0, z[both:]).mean() - prior * np.logaddexp(0, z[:both]).mean()
        sign = 1 if part >= 0 else -1
        slope = np.concatenate([-sign * prior * g[:both] / both, sign * g[both:] / len(unl)])
        if part >= 0:
            slope[:both] += prior * (g[:both] - 1) / both
        grad = np.append(x.T @ slope.astype(np.float32) + l1 * np.sign(w), slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    w[np.abs(w) < 0.05] = 0
    return w, float(b)


def _without_copies(rows: list[np.ndarray], common: np.ndarray, minima: int = 24, equal: int = 5) -> list[np.ndarray]:
    """Feature sets, those of one family of copies once: what a copied text says proves nothing again.

    Texts are of a family if ``equal`` of ``minima`` minima of hashes over their features
    outside ``common`` agree (about a fifth of these features shared), or through others.
    """
    rows = [f for f in rows if len(f)]
    m = np.empty((len(rows), minima), np.uint64)
    salts = T.mix(np.arange(1, minima + 1, dtype=np.uint64))
    for i, f in enumerate(rows):
        own = f[~np.isin(f, common)]
        own = own if len(own) else f
        m[i] = [T.mix(own ^ salt).min() for salt in salts]
    pairs = [np.zeros((0, 2), np.int64)]
    for i in range(len(rows) - 1):
        near = np.flatnonzero((m[i + 1 :] == m[i]).sum(1) >= equal) + i + 1
        pairs.append(np.column_stack([np.full(len(near), i), near]))
    i, j = np.concatenate(pairs).T
    first = np.unique(smallest_reached(len(rows), i, j))
    return [rows[k] for k in first]


def fit(positives: pa.Array, unlabelled: pa.Array, prior: float, features: int = 1024, members: int = 3) -> Model:
    """Choose features by how much oftener positives have them, then train the members."""
    p, u = _row_features(positives), _row_features(unlabelled)
    if not p or not u:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -6.0 if not p else 0.0)
    hu, cu = np.unique(np.concatenate(u), return_counts=True)
    p = _without_copies(p, hu[cu > 0.01 * len(u)])
    if not p:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    hp, cp = np.unique(np.concatenate(p), return_counts=True)
    at = np.minimum(np.searchsorted(hu, hp), max(0, len(hu) - 1))
    in_u = np.where(hu[at] == hp, cu[at], 0) if len(hu) else np.zeros(len(hp))
    # expected share among the rest, after the positives' own share of the unlabelled is taken out
    rest = np.maximum(in_u / len(u) - prior * cp / len(p), 0) / (1 - prior)
    rate = cp / len(p)
    gain = rate * np.log((rate + 1 / len(p)) / (rest + 1 / len(u)))
    chance = len(p) * (rest + 1 / len(u))  # positives that would have the feature if it meant nothing
    ok = np.flatnonzero((cp >= chance + 3 * np.sqrt(chance) + 2.5) & (gain > 0) & (rate > 6 * rest))
    best = np.sort(hp[ok[np.argsort(-gain[ok], kind="stable")[:features]]])
    if not len(best):
        return Model(best, np.zeros(0), float(np.log(prior / (1 - prior))))

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), len(best)), np.float32)
        for i, f in enumerate(rows):
            k = np.minimum(np.searchsorted(best, f), len(best) - 1)
            x[i, k[best[k] == f]] = 1
        return x

    xp, xu, w, b = matrix(p), matrix(u), np.zeros(len(best)), 0.0
    for k in range(members):
        draw = np.random.default_rng(k).permutation(len(u))[: max(1, len(u) * 4 // 5)]
        wk, bk = nnpu(xp, xu[draw], prior, seed=k)
        w, b = w + wk / members, b + bk / members
    keep = np.abs(w) > 1e-6
    return Model(best[keep], w[keep], b)


def train(docs: DataFrame, labels: DataFrame, max_positives: int = 1500, max_unlabelled: int = 3000) -> Model:
    """Fit on bounded samples (by hashed id) of the training fold's confirmed toxic and other texts.

    The class prior is the share of confirmed toxic rows among the fold's labelled rows.
    """
    known = labels.where(fold(F.col("doc_id"), 4) != 2).where(F.col("toxic").isNotNull()).select("doc_id", "toxic")
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(0.5, max(1e-3, toxic / n)) if n else 1e-3
    chosen = sample(known.where("toxic = 1").select("doc_id").distinct(), "doc_id", max_positives)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pos = texts.join(F.broadcast(chosen), "doc_id").select("text").toArrow().column("text")
    ids = sample(docs.where(fold(F.col("doc_id"), 4) != 2).select("doc_id"), "doc_id", max_unlabelled)
    unl = texts.join(F.broadcast(ids.distinct()), "doc_id").select("text").toArrow().column("text")
    return fit(pos.combine_chunks(), unl.combine_chunks(), prior)


def _score_batches(model: Model):
    f, wt = model.features, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = np.zeros(1 << PROBE_BITS, bool)
        shift = np.uint64(64 - PROBE_BITS)
        probe[f >> shift] = True
        for batch in batches:
            rows, found = [], []
            for w in T.words(batch.column("text")) if len(f) else ():
                r, h = _cores(w)
                k = np.flatnonzero(probe[h >> shift])
                at = np.minimum(np.searchsorted(f, h[k]), len(f) - 1)
                hit = f[at] == h[k]
                rows.append(r[k][hit])
                found.append(at[hit])
            score = np.full(batch.num_rows, model.bias)
            if rows:
                pair = np.unique(np.concatenate(rows).astype(np.int64) * max(1, len(f)) + np.concatenate(found))
                np.add.at(score, pair // max(1, len(f)), wt[pair % max(1, len(f))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_sigmoid(score))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Probability that each whole text is toxic.

    Null or empty text: the score of a text without features. A very long text goes through in
    blocks of whole words, its features counted once. One row per input row, repeated ones
    too; extra columns are not carried. Empty table: no rows.
    """
    out = arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _score_batches(model), "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
