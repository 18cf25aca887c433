"""Text quality by a sparse rule ensemble over statistics of a text.

Small boosted trees are grown on all labelled rows of the training fold; every path from a
root is a conjunctive rule; a lasso logistic regression keeps few of them. Rows stay in tasks,
as the bins that their statistics fall into; what reaches the driver are sums by node and bin,
and squares of the rules. The rules are compiled to Spark column expressions over the
statistics, so scoring stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import arrow_map, dropped, fold, saved

#: One bound of one statistic: (statistic, upper bound if True, value). Rules are tuples of them.
Bound = tuple[str, bool, float]
SYMBOLS = "#$%&*+<=>@\\^_`{|}~"
STATISTICS = ("chars", "words", "word_size", "symbols", "uppers", "digits", "stops", "marks", "new_words", "lines", "new_lines", "runs")


@dataclass(frozen=True)
class Rules:
    rules: tuple[tuple[Bound, ...], ...]
    weights: tuple[float, ...]
    bias: float


def _prefix(df: DataFrame) -> str:
    """A beginning that no column of ``df`` has, for the columns made here."""
    p = "_q"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


def _statistics(p: str) -> dict[str, Column]:
    """Statistics of a text; ratios of nothing are null here. The text, its length, words and lines have columns."""
    text, n = F.col(p + "t"), F.col(p + "n")

    def share(chars: str) -> Column:
        return (n - F.length(F.translate(text, chars, ""))) / n

    words, lines = F.size(p + "w"), F.size(p + "l")
    return {
        "chars": F.log1p(n.cast("double")),
        "words": F.log1p(words.cast("double")),
        "word_size": n / words,
        "symbols": share(SYMBOLS),
        "uppers": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digits": share("0123456789"),
        "stops": share(".,;:"),
        "marks": share("!?"),
        "new_words": F.size(F.array_distinct(p + "w")) / words,
        "lines": lines / words,
        "new_lines": F.size(F.array_distinct(p + "l")) / lines,
        "runs": F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]{2}")) / words,
    }


def with_statistics(df: DataFrame, keep: list[str], p: str) -> DataFrame:
    """``keep`` and the statistics under prefix ``p``, each computed once; a null text counts as empty."""
    t = df.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(p + "t"))
    t = t.select("*", F.nullif(F.length(p + "t"), F.lit(0)).alias(p + "n"), F.split(p + "t", r"[ \n\t\r]+").alias(p + "w"), F.split(p + "t", "\n").alias(p + "l"))
    return t.select(*keep, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(p + k) for k, c in _statistics(p).items()])


def _grow(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple, depth: int, out: list) -> np.ndarray:
    """One regression tree on gradients; returns its predictions over ``rows``, adds its paths to ``out``."""
    value = -grad[rows].sum() / (hess[rows].sum() + 1.0)
    best = (1e-6, -1, 0.0)
    if depth and len(rows) >= 20:
        base = grad[rows].sum() ** 2 / (hess[rows].sum() + 1.0)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            bin_ = np.searchsorted(c, x[rows, j], side="left")  # bin k holds values <= c[k]
            g = np.cumsum(np.bincount(bin_, grad[rows], len(c) + 1))[:-1]
            h = np.cumsum(np.bincount(bin_, hess[rows], len(c) + 1))[:-1]
            n = np.cumsum(np.bincount(bin_, minlength=len(c) + 1))[:-1]
            gt, ht = grad[rows].sum() - g, hess[rows].sum() - h
            gain = np.where((n >= 5) & (len(rows) - n >= 5), g * g / (h + 1) + gt * gt / (ht + 1) - base, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(c[k]))
    if best[1] < 0:
        return np.full(len(rows), value)
    _, j, cut = best
    low = x[rows, j] <= cut
    pred = np.empty(len(rows))
    for side, is_low in ((low, True), (~low, False)):
        step = (*path, (j, is_low, cut))
        out.append(step)
        pred[side] = _grow(x, cuts, grad, hess, rows[side], step, depth - 1, out)
    return pred


def _tidy(path: tuple) -> tuple:
    """A path with only the tightest bound of each statistic and side."""
    bounds: dict[tuple[int, bool], float] = {}
    for j, low, c in path:
        k = (j, low)
        bounds[k] = (min if low else max)(bounds.get(k, c), c)
    return tuple(sorted((j, low, c) for (j, low), c in bounds.items()))


def _covers(rule: tuple, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, j] <= c) if low else (x[:, j] > c) for j, low, c in rule])


def _lasso(r: np.ndarray, y: np.ndarray, lam: float, w: np.ndarray, b: float, steps: int = 150) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient of logistic loss + lam * |w|."""
    rate = 4 * len(y) / (np.linalg.norm(np.column_stack([r, np.ones(len(y))]), 2) ** 2)
    zw, zb, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(r @ zw + zb)))
        gw, gb = r.T @ (p - y) / len(y), (p - y).mean()
        nw = zw - rate * gw
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * lam, 0)
        nb = zb - rate * gb
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        zw, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATISTICS, trees: int = 40, depth: int = 3, seed: int = 0) -> Rules:
    """Trees, all their rules (those that cover the same rows once), and lasso weights.

    The penalty is the largest whose loss on a held fifth of the rows is within one standard
    error of the least.
    """
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Rules((), (), float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64))) for j in range(x.shape[1])]
    paths: list[tuple] = []
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        found: list[tuple] = []
        _grow(x, cuts, p - y, p * (1 - p), rows, (), depth, found)
        all_rows = np.arange(len(y))
        f += 0.3 * _grow(x, cuts, p - y, p * (1 - p), all_rows, (), depth, found)
        paths += found
    cover: dict[bytes, tuple] = {}
    for rule in sorted({_tidy(p) for p in paths}, key=lambda r: (len(r), r)):
        c = _covers(rule, x)
        if 5 <= c.sum() <= len(y) - 5:
            cover.setdefault(c.tobytes(), rule)
    rules = list(cover.values())
    if not rules:
        return Rules((), (), float(f[0]))
    r = np.column_stack([_covers(k, x) for k in rules]).astype(np.float64)
    held = rng.random(len(y)) < 0.2
    path, w, b = [], np.zeros(len(rules)), float(np.log(y.mean() / (1 - y.mean())))
    for lam in (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005, 0.0002):
        w, b = _lasso(r[~held], y[~held], lam, w, b)
        z = r[held] @ w + b
        loss = np.logaddexp(0, np.where(y[held] > 0, -z, z)) if held.any() else np.zeros(1)
        path.append((float(loss.mean()), float(loss.std() / len(loss) ** 0.5), lam, w, b))
    least, error, *_ = min(path, key=lambda k: k[0])
    _, _, lam, w, b = next(k for k in path if k[0] <= least + error)
    w, b = _lasso(r, y, lam, w, b)
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    return Rules(tuple(tuple((names[j], low, float(c)) for j, low, c in rules[k]) for k in keep), tuple(float(w[k]) for k in keep), float(b))


CUTS = 64  # of each statistic, at equal shares of the rows
LAMBDAS = (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005, 0.0002)


def _bin_batches(cuts: list[np.ndarray]):
    """Rows as bins (bin k of a statistic holds the values up to its cut k), labels and hashed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.column_stack([np.searchsorted(c, batch.column(f"_q{k}").to_numpy(), side="left") for k, c in zip(STATISTICS, cuts, strict=True)])
            key = T.mix(batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(1))
            cols = (bins.astype("u1"), batch.column("_y").to_numpy(zero_copy_only=False).astype("<f8"), key.astype("<u8"))
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], names=["bins", "y", "key"])

    return run


def _sum(binned: DataFrame, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``part(bins, labels, hashed ids)`` over all rows; a task sends one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for bins, y, key in zip(*(batch.column(k) for k in ("bins", "y", "key")), strict=True):
                got = part(np.frombuffer(bins.as_buffer(), "u1").reshape(-1, len(STATISTICS)), np.frombuffer(y.as_buffer(), "<f8"), np.frombuffer(key.as_buffer(), "<u8"))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([str(total.dtype)]), pa.array([list(total.shape)], pa.list_(pa.int64()))], names=["blob", "kind", "shape"])

    sent = arrow_map(binned, run, "blob binary, kind string, shape array<long>").collect()
    return sum(np.frombuffer(r.blob, r.kind).reshape(r.shape) for r in sent)


def _forest(leaves: list[tuple[tuple, float]], base: float, bins: np.ndarray) -> np.ndarray:
    f = np.full(len(bins), base)
    for path, value in leaves:
        f += value * (_covers(path, bins) if path else 1.0)
    return f


def _histograms(leaves: list, base: float, nodes: list[list[tuple]], turn: int):
    """Gradients, Hessians and rows by bin in each node of two trees: one over half of the rows, one over all."""
    width = CUTS + 1
    at = np.arange(len(STATISTICS)) * width

    def part(bins: np.ndarray, y: np.ndarray, key: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-_forest(leaves, base, bins)))
        half = (T.mix(key + np.uint64(turn)) & np.uint64(1)).astype(bool)
        out = np.zeros((sum(map(len, nodes)), 3, len(STATISTICS) * width))
        k = 0
        for some, mine in zip(nodes, (half, np.ones(len(y), bool)), strict=True):
            for path in some:
                own = np.flatnonzero(mine & _covers(path, bins) if path else mine)
                cell = (bins[own] + at).ravel()
                for i, w in enumerate(((p - y)[own], (p * (1 - p))[own], np.ones(len(own)))):
                    out[k, i] = np.bincount(cell, np.repeat(w, len(at)), out.shape[2])
                k += 1
        return out

    return part


def _split(hist: np.ndarray, cuts: list[np.ndarray]) -> tuple[float, tuple[int, int] | None, tuple[float, float]]:
    """A node's value, the statistic and bin that divide it best, if any does, and the values of both sides."""
    g, h, n = hist.reshape(3, len(STATISTICS), CUTS + 1)
    grad, hess, rows = g[0].sum(), h[0].sum(), n[0].sum()
    value, best, where, sides = float(-grad / (hess + 1)), 1e-6, None, (0.0, 0.0)
    if rows >= 20:
        for j, c in enumerate(cuts):
            a, b, m = (np.cumsum(x[j])[: len(c)] for x in (g, h, n))
            gain = np.where((m >= 5) & (rows - m >= 5), a * a / (b + 1) + (grad - a) ** 2 / (hess - b + 1) - grad**2 / (hess + 1), 0)
            if len(c) and gain.max() > best:
                k = int(gain.argmax())
                best, where = float(gain[k]), (j, k)
                sides = (float(-a[k] / (b[k] + 1)), float((a[k] - grad) / (hess - b[k] + 1)))
    return value, where, sides


def _newton(rules: list[tuple], w: np.ndarray, rows: Callable[[np.ndarray], np.ndarray]):
    """The quadratic that touches the logistic loss at ``w`` (bias last): its matrix, its vector, and the number of rows."""

    def part(bins: np.ndarray, y: np.ndarray, key: np.ndarray) -> np.ndarray:
        use = rows(key)
        x = np.column_stack([*(_covers(k, bins[use]) for k in rules), np.ones(use.sum(), bool)]).astype(np.float64)
        z = x @ w
        p = 1 / (1 + np.exp(-z))
        v = np.maximum(p * (1 - p), 0.01)
        return np.vstack([(x * v[:, None]).T @ x, x.T @ (v * z + y[use] - p), np.full(x.shape[1], len(x), float)])

    return part


def _lasso_all(binned: DataFrame, rules: list[tuple], w: np.ndarray, lam: float, rows: Callable[[np.ndarray], np.ndarray], steps: int = 6) -> np.ndarray:
    """Logistic lasso over all rows: proximal Newton steps, each one pass."""
    for _ in range(steps):
        got = _sum(binned, _newton(rules, w, rows))
        n = max(1.0, got[-1, 0])
        a, b, was = got[:-2] / n, got[-2] / n, w
        rate = 1 / max(np.linalg.norm(a, 2), 1e-12)
        z, t = w.copy(), 1.0
        for _ in range(2000):
            new = z - rate * (a @ z - b)
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * lam, 0)
            nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
            z, w, t = new + (t - 1) / nt * (new - w), new, nt
        if np.abs(w - was).max() < 1e-3:
            break
    return w


def _held(key: np.ndarray) -> np.ndarray:
    return T.mix(key + np.uint64(0x51)) % np.uint64(5) == 0


def fit_all(binned: DataFrame, cuts: list[np.ndarray], trees: int = 40, depth: int = 3) -> Rules:
    """As ``fit``, over all rows of a table of bins: a pass for a level of trees, and for a step of the lasso."""
    n, good = _sum(binned, lambda bins, y, key: np.array([len(y), y.sum()])) + np.zeros(2)  # nothing, if there are no rows
    if not 0 < good < n:
        rate = (good + 0.5) / (n + 1)
        return Rules((), (), float(np.log(rate / (1 - rate))))
    base = float(np.log(good / (n - good)))
    leaves: list[tuple[tuple, float]] = []
    paths: set[tuple] = set()
    for turn in range(trees):
        nodes: list[list[tuple]] = [[()], [()]]
        more: list[tuple[tuple, float]] = []
        for level in range(depth):
            if not any(nodes):
                break
            hist = iter(_sum(binned, _histograms(leaves, base, nodes, turn)))
            below: list[list[tuple]] = [[], []]
            for k, some in enumerate(nodes):
                for path in some:
                    value, where, sides = _split(next(hist), cuts)
                    two = [] if where is None else [(*path, (where[0], low, where[1])) for low in (True, False)]
                    below[k] += two
                    if k and where is None:
                        more.append((path, 0.3 * value))
                    elif k and level == depth - 1:
                        more += [(p, 0.3 * v) for p, v in zip(two, sides, strict=True)]
            paths.update(_tidy(p) for some in below for p in some)
            nodes = below
        leaves += more
    found = sorted(paths, key=lambda r: (len(r), r))
    if not found:
        return Rules((), (), base)
    # rules that cover the same rows: equal numbers and equal sums of hashed ids
    cover = _sum(binned, lambda bins, y, key: np.array([[c.sum(), T.mix(key[c]).sum()] for c in (_covers(k, bins) for k in found)], np.uint64))
    first: dict[tuple, tuple] = {}
    for rule, (rows, mark) in zip(found, cover.tolist(), strict=True):
        if 5 <= rows <= n - 5:
            first.setdefault((rows, mark), rule)
    rules = list(first.values())
    if not rules:
        return Rules((), (), base)
    w, path = np.append(np.zeros(len(rules)), base), []
    for lam in LAMBDAS:
        w = _lasso_all(binned, rules, w, lam, lambda key: ~_held(key))
        path.append(w)
    every = np.column_stack(path)

    def losses(bins: np.ndarray, y: np.ndarray, key: np.ndarray) -> np.ndarray:
        use = _held(key)
        z = np.column_stack([*(_covers(k, bins[use]) for k in rules), np.ones(use.sum(), bool)]) @ every
        loss = np.logaddexp(0, np.where(y[use, None] > 0, -z, z))
        return np.vstack([loss.sum(0), (loss**2).sum(0), np.full(len(path), len(loss), float)])

    one, two, many = _sum(binned, losses)
    mean = one / np.maximum(many, 1)
    error = np.sqrt(np.maximum(two / np.maximum(many, 1) - mean**2, 0) / np.maximum(many, 1))
    best = int(mean.argmin())
    pick = int(np.flatnonzero(mean <= mean[best] + error[best])[0])
    w = _lasso_all(binned, rules, path[pick], LAMBDAS[pick], lambda key: np.ones(len(key), bool))
    keep = np.flatnonzero(np.abs(w[:-1]) > 1e-4)
    return Rules(tuple(tuple((STATISTICS[j], low, float(cuts[j][c])) for j, low, c in rules[k]) for k in keep), tuple(float(w[k]) for k in keep), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame) -> Rules:
    """Fit on the statistics of all labelled rows of the training fold.

    Labels are joined to statistics, so that no text is shuffled. Cuts come from Spark's
    percentiles of all rows (exact to a 10,000th of the rows). Tasks are as many as cores: each
    sends sums by bin, or the square of the rules.
    """
    known = labels.where(fold(F.col("doc_id"), 4) != 2).where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int"))
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("_y"))
    stats = with_statistics(docs.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text"), ["doc_id"], "_q")
    rows = saved(stats.join(chosen, "doc_id"), "quality")
    shares = [float(q) for q in np.linspace(0.01, 0.99, CUTS)]
    at = rows.select(*[F.percentile_approx(f"_q{k}", shares, 10000).alias(k) for k in STATISTICS]).first()
    cuts = [np.unique(np.array(at[k] or [], float)) for k in STATISTICS]
    cores = max(2, docs.sparkSession.sparkContext.defaultParallelism)
    binned = saved(arrow_map(rows.coalesce(cores), _bin_batches(cuts), "bins binary, y binary, key binary"), "quality-bins")
    rules = fit_all(binned.coalesce(min(cores, binned.count() // 32 + 1)), cuts)  # about 32,000 rows a task, if there are cores
    dropped(rows)
    dropped(binned)
    return rules


def compiled(rules: Rules, p: str) -> Column:
    """The ensemble's probability as one column expression over the statistics' columns."""
    terms = [F.lit(rules.bias)]
    for rule, w in zip(rules.rules, rules.weights, strict=True):
        bounds = [(F.col(p + k) <= c) if low else (F.col(p + k) > c) for k, low, c in rule]
        terms.append(F.when(reduce(lambda a, b: a & b, bounds), F.lit(w)).otherwise(F.lit(0.0)))
    while len(terms) > 1:  # a balanced sum: its depth is the logarithm of the number of rules
        terms = [reduce(lambda a, b: a + b, terms[k : k + 2]) for k in range(0, len(terms), 2)]
    return 1 / (1 + F.exp(-terms[0]))


def score(docs: DataFrame, rules: Rules, threshold: float = 0.7) -> DataFrame:
    """Probability that each whole text is good.

    Null or empty text: scored with all ratios 0. One row per input row; extra columns are
    not carried. Empty table: no rows. Everything is built-in column expressions.
    """
    scored = with_statistics(docs, ["doc_id"], "_q").select("doc_id", compiled(rules, "_q").alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, rules: Rules, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more.

    A row number stands beside the statistics and in the condition: without it, the condition
    would move below them, and each rule would count its statistics again.
    """
    p = _prefix(docs)
    stats = with_statistics(docs, docs.columns, p).withColumn(p + "row", F.monotonically_increasing_id())
    return stats.where((F.col(p + "row") >= 0) & (compiled(rules, p) >= threshold)).select(docs.columns)
