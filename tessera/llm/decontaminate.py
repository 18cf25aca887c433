"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all passages of the corpus.
2. A randomised singular value decomposition of the TF-IDF passages of all texts and of the
   benchmark: tasks multiply their rows with the current basis and send the product back in
   slices, the driver holds only basis-sized matrices.
3. Every text's windows are projected and whitened; windows whose cosine with an item reaches
   a threshold are candidates. So are, whatever their cosine, windows that hold enough of the
   item's rarest words: no window that passes the check of its words can hold fewer. Bit maps
   of their words rule out candidates in which too few of the item's words can be.
4. A candidate stays if the longest common subsequence of words covers enough of the item,
   and enough of its answer (its last words).

Items go through in blocks of bounded size, against all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import text as T
from .common import arrow_map, sample, shared_dir
from .shingles import _shingles

FEATURES, RANK, EXTRA = 1 << 16, 96, 8
SIGNS = 4  # entries of a word's row in the random basis
PASSAGE, STEP = 32, 8  # words of a passage for the statistics; words between windows
WINDOWS = (3, 5, 9)  # steps in a window; an item is sought in the first that holds it
LONG = (WINDOWS[-1] - 1) * STEP  # longer items are sought whole, in windows of their own size
ITEM_BLOCK = 4000
SHORT = 8  # shorter items are sought word for word
KEY, KEY_PART, FLAGS = 3, 8, 1 << 18  # rare words to be met: an eighth of the item, at least 3; entries of their first test
SLICES = 8


@dataclass(frozen=True)
class Items:
    ids: list
    words: list[np.ndarray]


def _feature(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(FEATURES - 1)).astype(np.int64)


def _steps(at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, row) of runs of ``step`` words that do not cross rows; at: rows' first words and the end."""
    size = np.diff(at)
    count = -(-size // step)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return at[row] + nth * step, row


def _bits(h: np.ndarray) -> np.ndarray:
    """Each word as one bit of 256."""
    out = np.zeros((len(h), 4), np.uint64)
    out[np.arange(len(h)), ((h >> np.uint64(20)) & np.uint64(3)).astype(np.int64)] = np.uint64(1) << ((h >> np.uint64(22)) & np.uint64(63))
    return out


def _slices(a: np.ndarray) -> pa.RecordBatch:
    parts = np.array_split(a, SLICES)
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "blob"])


def _total(sent: DataFrame, dtype: str, shape: tuple) -> np.ndarray:
    """Sum of the matrices that tasks sent in slices."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, b in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                a = np.frombuffer(b.as_buffer(), dtype)
                sums[p] = sums[p] + a if p in sums else a.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "blob"])

    rows = sorted(arrow_map(sent.repartition(SLICES, "part"), add, "part int, blob binary").collect())
    if not rows:
        return np.zeros(shape, dtype)
    return np.concatenate([np.frombuffer(r.blob, dtype) for r in rows]).reshape(shape)


def _frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(FEATURES + 1, np.int64)  # the last one counts passages
    for batch in batches:
        for _, at, h in T.row_words(batch.column("text")):
            head, _ = _steps(at, PASSAGE)
            df[-1] += len(head)
            cell, first = _cells(head, _feature(h))
            df[:-1] += np.bincount(cell[first] & (FEATURES - 1), minlength=FEATURES)
    yield _slices(df)


def _cells(head: np.ndarray, feat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's passage times FEATURES plus its feature, sorted (in 32 bits if they hold them), and where equal ones begin."""
    of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(feat))))
    cell = of * FEATURES + feat
    cell = np.sort(cell.astype(np.uint32) if len(head) <= (1 << 32) // FEATURES else cell)
    return cell, np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))


def _norms(head: np.ndarray, feat: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Length of each passage's vector; a word that repeats adds up."""
    cell, first = _cells(head, feat)
    w = np.diff(np.append(first, len(cell))) * idf[cell[first] & (FEATURES - 1)]
    return np.sqrt(np.bincount(cell[first] // FEATURES, w * w, len(head)))


def _sums(table: np.ndarray, which: np.ndarray, head: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows ``which`` of the table over runs of at most ``step``, longer runs first, and where each run's sum stands.

    One place in the run after the other: the runs that have it stand in front.
    """
    size = np.diff(np.append(head, len(which)))
    order = np.argsort((step - size).astype(np.uint8), kind="stable")
    more = len(size) - np.cumsum(np.bincount(size, minlength=step + 1))
    head = head[order]
    out = table.take(which[head], 0)
    for k in range(1, step):
        out[: more[k]] += table.take(which[head[: more[k]] + k], 0)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return out, place


def _row_sums(y: np.ndarray, which: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of rows ``which`` of ``y`` over the runs that begin at ``at``; eight by eight, as reduceat is slow along rows."""
    while True:
        first, run = _steps(at, 8)
        y, which = _sums(y, which, first, 8)
        if len(first) == len(at) - 1:
            return y.take(which, 0)
        at = np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(first))


def _table(uri: str, columns: int) -> np.ndarray:
    """A matrix of FEATURES rows in shared storage."""
    return np.asarray(store.mapped(uri)).view("<f4").reshape(FEATURES, columns)


def _products(column: pa.Array, idf: np.ndarray, weighted: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of A times the basis, A being unit passages; ``weighted``: the basis, its rows times the words' weights."""
    for _, at, h in T.row_words(column, 1 << 17):
        head, _ = _steps(at, PASSAGE)
        feat = _feature(h)
        norm = np.maximum(_norms(head, feat, idf), 1e-12).astype(np.float32)
        sums, place = _sums(weighted, feat, head, PASSAGE)
        yield sums.take(place, 0) / norm[:, None]


def _sketch(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A random basis with ``SIGNS`` entries of 1 or -1 in each word's row: their columns, the entries."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, RANK + EXTRA, (SIGNS, FEATURES)), rng.choice([-1.0, 1.0], (SIGNS, FEATURES))


def _multiply_batches(idf_file: str, seed: int):
    """A-transposed times A times the random basis, over a task's passages A: the rows of words that it met, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, (column, sign), width = _table(idf_file, 1).ravel(), _sketch(seed), RANK + EXTRA
        sign *= idf
        out, met = np.zeros((FEATURES, width), np.float32), np.zeros(FEATURES, bool)
        for batch in batches:
            for _, at, h in T.row_words(batch.column("text"), 1 << 19):
                head, _ = _steps(at, PASSAGE)
                feat = _feature(h)
                of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(feat))))
                y = sum(np.bincount(of * width + c[feat], s[feat], len(head) * width) for c, s in zip(column, sign, strict=True)).reshape(-1, width)
                y = (y / np.maximum(_norms(head, feat, idf), 1e-12)[:, None] ** 2).astype(np.float32)
                order = np.argsort(feat.astype(np.uint16), kind="stable")
                f, of = feat[order], of[order]
                for a in range(0, len(f), 1 << 13):  # some words at a time stay in the cache
                    own = f[a : a + (1 << 13)]
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    out[own[first]] += _row_sums(y, of[a : a + (1 << 13)], np.append(first, len(own)))
                met[f] = True
        for part, rows in enumerate(np.array_split(np.arange(FEATURES), SLICES)):
            rows = rows[met[rows]]
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows.astype("<i4").tobytes()], pa.binary()), pa.array([(out[rows] * idf[rows, None]).astype("<f4").tobytes()], pa.binary())], names=["part", "rows", "blob"])

    return run


def _gram_batches(idf_file: str, basis_file: str):
    """The square of A times the basis, over a task's passages A."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, weighted = _table(idf_file, 1).ravel(), _table(basis_file, RANK + EXTRA)
        out = np.zeros((RANK + EXTRA, RANK + EXTRA))
        for batch in batches:
            for y in _products(batch.column("text"), idf, weighted):
                out += y.T @ y
        yield _slices(out)

    return run


def _rows_total(sent: DataFrame, columns: int, folder: str) -> np.ndarray:
    """Sum of the rows that tasks sent in slices; the sums come as files in shared storage, not through the driver's JVM."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        parts = np.array_split(np.arange(FEATURES), SLICES)
        for batch in batches:
            for p, rows, b in zip(batch.column("part").to_pylist(), batch.column("rows"), batch.column("blob"), strict=True):
                own = sums.setdefault(p, np.zeros((len(parts[p]), columns), np.float32))
                own[np.frombuffer(rows.as_buffer(), "<i4") - parts[p][0]] += np.frombuffer(b.as_buffer(), "<f4").reshape(-1, columns)
        uris = [store.write(folder, "slice", s.astype("<f4", copy=False)) for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(uris, pa.string())], names=["part", "uri"])

    out = np.zeros((FEATURES, columns), np.float32)
    slices = np.array_split(out, SLICES)  # views
    for r in arrow_map(sent.repartition(SLICES, "part"), add, "part int, uri string").collect():
        slices[r.part][:] = store.mapped(r.uri).view("<f4").reshape(-1, columns)
    return out


def _orthonormal(y: np.ndarray) -> None:
    """Make the columns of ``y`` an orthonormal basis of what they span, in place: a slice of rows at a time, then the slices' triangles."""
    slices, triangles = np.array_split(y, SLICES), []
    for s in slices:
        s[:], r = np.linalg.qr(s.astype(np.float64))
        triangles.append(r)
    turn = np.linalg.qr(np.concatenate(triangles))[0]
    for s, t in zip(slices, np.split(turn, SLICES), strict=True):
        s[:] = s @ t


def fit(docs: DataFrame, benchmark: DataFrame, max_texts: int | None = None, seed: int = 0) -> tuple[str, str]:
    """Files of the word table (FEATURES, RANK) and of the words' weights: a window's latent vector is the sum of its words' rows.

    Frequencies are of all texts, and the decomposition is of the passages of all texts and
    benchmark items: their product with a random basis, then the square of their product with
    what that spans. A caller may bound it to ``max_texts`` texts (by hashed id). Tasks are as
    many as cores, since each sends the rows of the words that it met.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("text").cast("string"))
    df = _total(arrow_map(text, _frequency_batches, "part int, blob binary"), "<i8", (FEATURES + 1,))
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1e-3
    some = text
    if max_texts is not None:
        ids = sample(docs.select("doc_id"), "doc_id", max_texts).distinct()
        some = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(ids), "doc_id").select("text")
    some = some.unionByName(benchmark.select(F.col("text").cast("string"))).coalesce(max(2, spark.sparkContext.defaultParallelism))
    folder = shared_dir(spark, "latent")
    idf_file = store.write(folder, "idf", idf.astype("<f4"))

    # on the driver: one matrix of FEATURES rows, changed in place, and slices of it
    basis = _rows_total(arrow_map(some, _multiply_batches(idf_file, seed), "part int, rows binary, blob binary"), RANK + EXTRA, folder)
    _orthonormal(basis)
    basis *= idf.astype(np.float32)[:, None]
    gram = _total(arrow_map(some, _gram_batches(idf_file, store.write(folder, "basis", basis)), "part int, blob binary"), "<f8", (RANK + EXTRA, RANK + EXTRA))
    value, turn = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(-value)[:RANK]
    scale = 1 / np.sqrt(np.maximum(value[order], max(value.max() * 1e-6, 1e-12)))
    whitened = (turn[:, order] * scale).astype(np.float32)
    return store.write(folder, "table", *(s @ whitened for s in np.array_split(basis, SLICES))), idf_file


def common_subsequence(item: dict[int, int], words: list[int], size: int) -> int:
    """Words of the item that stay in a longest common subsequence, as a bit mask of its positions' row.

    ``item``: word -> bits of its positions. Bit-parallel: one pass over ``words``; returns
    the row vector, in which every zero bit is one matched word.
    """
    full = (1 << size) - 1
    v = full
    for m in filter(None, map(item.get, words)):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return v


def _matched(item: dict[int, int], words: list[int], size: int) -> int:
    return size - common_subsequence(item, words, size).bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, x in enumerate(words.tolist()):
        out[x] = out.get(x, 0) | 1 << k
    return out


@dataclass(frozen=True)
class Rare:
    """Words by which items are met: sorted words, where the items of each begin in ``who``, words needed by item."""

    words: np.ndarray
    at: np.ndarray
    who: np.ndarray
    need: np.ndarray
    flag: np.ndarray


def _rare(words: list[np.ndarray], which: list[int], idf: np.ndarray, share: float) -> Rare:
    """Of each item, its rarest words.

    A window with m of an item's n words in order lacks at most n - m of them, so it has k of
    any n - m + k. Which ones are taken decides the work, never the result.
    """
    need, found, who = np.ones(len(words), np.int64), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k in which:
        n = len(words[k])
        m = int(np.ceil(share * n - 1e-9))
        need[k] = max(1, min(m, max(KEY, n // KEY_PART)))
        rarest = np.argsort(-idf[_feature(words[k])], kind="stable")[: n - m + need[k]]
        found.append(np.unique(words[k][rarest]))
        who.append(np.full(len(found[-1]), k, np.int64))
    every, of = np.concatenate(found), np.concatenate(who)
    order = np.argsort(every, kind="stable")
    known, at = np.unique(every[order], return_index=True)
    flag = np.zeros(FLAGS, bool)
    flag[(known & np.uint64(FLAGS - 1)).astype(np.int64)] = True
    return Rare(known, np.append(at, len(every)).astype(np.int64), of[order], need, flag)


def _met(h: np.ndarray, head: np.ndarray, rare: Rare) -> tuple[np.ndarray, np.ndarray]:
    """(step, item) of every rare word of an item, by item and place."""
    p = np.flatnonzero(rare.flag[(h & np.uint64(FLAGS - 1)).astype(np.int64)])
    q = np.searchsorted(rare.words, h[p])
    same = rare.words[np.minimum(q, max(0, len(rare.words) - 1))] == h[p] if len(rare.words) else np.zeros(len(p), bool)
    p, q = p[same], q[same]
    count = rare.at[q + 1] - rare.at[q]
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    item = rare.who[np.repeat(rare.at[q], count) + nth]
    order = np.argsort(item, kind="stable")
    return np.searchsorted(head, np.repeat(p, count)[order], side="right") - 1, item[order]


def _near(step: np.ndarray, item: np.ndarray, need: np.ndarray, begin: np.ndarray, last: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(window's first step, item) of windows of ``w`` steps that hold, with the steps beside them, the words needed."""
    j = np.arange(len(step)) + need[item] - 1
    i = np.flatnonzero(j < len(step))
    i = i[(item[j[i]] == item[i]) & (begin[step[j[i]]] == begin[step[i]])]
    a, b = step[i], step[j[i]]
    low = np.maximum(b - w, begin[a])
    count = np.maximum(np.minimum(a + 1, np.maximum(begin[a], last[a] - w)) - low + 1, 0)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    got = np.unique((np.repeat(low, count) + nth) * len(need) + np.repeat(item[i], count))
    return got // len(need), got % len(need)


def _search_batches(table_file: str, idf_file: str, items: Items, cosine: float, share: float, answer_share: float):
    sizes = [len(w) for w in items.words]
    tails = [max(3, n // 4) for n in sizes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(table_file, RANK)
        masks = [_masks(w) for w in items.words]
        ends = [_masks(w[-t:]) for w, t in zip(items.words, tails, strict=True)]
        long_ = [k for k, n in enumerate(sizes) if n >= SHORT]
        home = {k: next((i for i, w in enumerate(WINDOWS) if sizes[k] <= (w - 1) * STEP), -1) for k in long_}
        groups = []
        for i, w in enumerate(WINDOWS):
            own = np.array([k for k in long_ if home[k] == i], np.int64)
            if len(own):
                v = np.stack([table[_feature(items.words[k])].sum(0) for k in own])
                maps = np.stack([np.bitwise_or.reduce(_bits(items.words[k])) for k in own])
                spare = np.array([sizes[k] - int(np.ceil(share * sizes[k] - 1e-9)) for k in own])
                groups.append((w, own, (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T.astype(np.float32), maps, spare))
        whole = {k: v / max(np.linalg.norm(v), 1e-12) for k in long_ if home[k] < 0 for v in [table[_feature(items.words[k])].sum(0)]}
        rare = _rare(items.words, long_, _table(idf_file, 1).ravel(), share)
        exact: dict[int, dict[int, list[int]]] = {}
        for k, n in enumerate(sizes):
            if 0 < n < SHORT:
                exact.setdefault(n, {}).setdefault(int(_shingles(items.words[k], n)[0]), []).append(k)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            best: dict[tuple[int, int], tuple[int, float]] = {}
            for rows, at, h in T.row_words(batch.column("text"), 1 << 18):
                for r, k, n, c in _hits(h, at, table, groups, whole, rare, masks, ends, sizes, tails, cosine, share, answer_share):
                    key = (int(rows[r]), k)
                    if key not in best or (n, c) > best[key]:
                        best[key] = (n, c)
                for n, known in exact.items():
                    want = np.array(list(known), np.uint64)
                    for r in range(len(rows)):
                        w = h[at[r] : at[r + 1]]
                        if len(w) >= n:
                            for x in np.intersect1d(_shingles(w, n), want).tolist():
                                for k in known[x]:
                                    best[int(rows[r]), k] = (n, 1.0)
            keys = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[r] for r, _ in keys], pa.int64()),
                    pa.array([items.ids[k] for _, k in keys], pa.int64()),
                    pa.array([sizes[k] for _, k in keys], pa.int64()),
                    pa.array([best[x][0] for x in keys], pa.int64()),
                    pa.array([best[x][1] for x in keys], pa.float64()),
                ],
                names=["doc_id", "item_id", "item_words", "common_words", "cosine"],
            )

    return run


def _hits(h, at, table, groups, whole, rare, masks, ends, sizes, tails, cosine, share, answer_share) -> Iterator[tuple[int, int, int, float]]:
    """(row, item, matched words, cosine) of windows that pass both checks."""
    head, row = _steps(at, STEP)
    if not len(head):
        return
    steps, place = _sums(table, _feature(h), head, STEP)
    steps = steps.take(place, 0)
    maps = np.bitwise_or.reduceat(_bits(h), head)
    n_steps = len(head)
    last = np.searchsorted(row, row, side="right")  # the step after the row's last
    left = last - np.arange(n_steps)
    first = np.append(True, row[1:] != row[:-1])
    begin = np.searchsorted(row, row)  # the row's first step
    met, met_item = _met(h, head, rare)
    running, wide = np.zeros_like(steps), 0
    for w, own, vectors, own_maps, spare in groups:
        for o in range(wide, min(w, n_steps)):  # windows grow from the last group's
            running[: n_steps - o] += steps[o:]
        wide = w
        keep = np.flatnonzero(left >= w)
        short = np.flatnonzero(first & (left < w))  # a whole row that is shorter than a window
        win = running[keep]
        if len(short):
            win = np.concatenate([win, np.stack([steps[i : last[i]].sum(0) for i in short])])
            keep = np.concatenate([keep, short])
        win /= np.maximum(np.sqrt(np.einsum("ij,ij->i", win, win)), 1e-12)[:, None]
        place, column = np.full(n_steps, -1), np.full(len(sizes), -1)
        place[keep], column[own] = np.arange(len(keep)), np.arange(len(own))
        mine = column[met_item] >= 0
        near, near_item = _near(met[mine], met_item[mine], rare.need, begin, last, w)
        near, near_item = place[near], column[near_item]
        for a in range(0, len(keep), 8192):
            cos = win[a : a + 8192] @ vectors
            meets = cos >= cosine
            here = (near >= a) & (near < a + 8192)
            meets[near[here] - a, near_item[here]] = True
            ci, cj = np.divmod(np.flatnonzero(meets), len(own))  # much faster than both indices at once
            # each of the item's bits that the window lacks is a word that it lacks
            there = np.zeros((len(ci), 4), np.uint64)
            for o in range(-1, w + 1):
                there |= maps[np.clip(keep[a + ci] + o, 0, len(maps) - 1)]
            ok = np.bitwise_count(own_maps[cj] & ~there).sum(1, dtype=np.int64) <= spare[cj]
            for i, j in zip(ci[ok], cj[ok], strict=True):
                s, k = keep[a + i], int(own[j])
                n = sizes[k]
                start = max(int(at[row[s]]), int(head[s]) - STEP)
                stop = min(int(at[row[s] + 1]), int(head[s]) + (w + 1) * STEP)
                words = h[start:stop].tolist()
                got = _matched(masks[k], words, n)
                if got >= share * n and _matched(ends[k], words, tails[k]) >= answer_share * tails[k]:
                    yield int(row[s]), k, got, float(cos[i, j])
    for k in np.unique(met_item).tolist():
        if k in whole:
            n, mine = sizes[k], met_item == k
            # windows of one and a half times the item; one check covers those that begin within an eighth of the item
            move = max(1, n // LONG)
            w = -(-(n + n // 2) // STEP)
            near, _ = _near(met[mine], met_item[mine], rare.need, begin, last, w)
            for s in np.unique(begin[near] + (near - begin[near]) // move * move).tolist():
                start = max(int(at[row[s]]), int(head[s]) - STEP)
                stop = min(int(at[row[s] + 1]), int(head[s]) + (w + move) * STEP)
                words = h[start:stop].tolist()
                got = _matched(masks[k], words, n)
                if got >= share * n and _matched(ends[k], words, tails[k]) >= answer_share * tails[k]:
                    v = table[_feature(h[start:stop])].sum(0)
                    yield int(row[s]), k, got, float(v @ whole[k] / max(np.linalg.norm(v), 1e-12))


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.4, share: float = 0.6, answer_share: float = 0.5, max_texts: int | None = None) -> DataFrame:
    """Pairs (doc_id, item_id) of texts that hold an item or a paraphrase that keeps its words' order.

    ``common_words`` of ``item_words`` are the longest common subsequence in the best window,
    at least ``share`` of the item; of its last quarter, ``answer_share`` must be there.
    A window has 24, 40 or 72 words for items of up to 16, 32 and 64, one and a half times a
    longer item's, and a few more. Items of fewer than eight words must be there word for
    word; null or empty items are in nothing, and null or empty texts hold nothing. Words are
    lower-cased (A-Z). Repeated rows give equal rows once. Extra columns are not carried.
    Empty tables: no rows.
    """
    table, idf = fit(docs, benchmark, max_texts)
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    blocks = -(-known.count() // ITEM_BLOCK)
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, item_words long, common_words long, cosine double")
    for nth in range(blocks):  # a block's items are of bounded number
        got = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == nth).orderBy("item_id", "text").toArrow()
        words: list[np.ndarray] = [np.zeros(0, np.uint64)] * got.num_rows
        for rows, at, h in T.row_words(got.column("text").combine_chunks()):
            for k, r in enumerate(rows):
                words[r] = h[at[k] : at[k + 1]]
        items = Items(got.column("item_id").to_pylist(), words)
        out = out.unionByName(arrow_map(text, _search_batches(table, idf, items, cosine, share, answer_share), out.schema))
    return out.distinct()


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows without doc_id stay."""
    bad = contaminated(docs, benchmark, **how).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
