"""Interpolated modified Kneser-Ney trigram model over words.

Counted in Spark in five steps, each a map to sorted arrays, a shuffle of those arrays by
range, and a merge that writes one file a range to shared storage:

1. words: hash and count. A word's id is its rank by hash.
2. pairs of ids (previous, word): a bijective hash of the pair, and its count. Pairs are
   spread by their own hash, so no word is too frequent for one task. A pair's id is its rank.
3. trigrams: two pairs that overlap in a word, as ids, in the range of the first pair; by first
   pair, how many different words follow it, and how many of them twice and oftener.
4. by second pair: how many different words come before it, which is the pair's own count in
   the lower order. Pairs after the begin mark keep their plain count.
5. by word: how many different words come before it, and how many follow it once, twice,
   oftener, and in all, by the counts of step 4.

Workers map the files into memory and look words, pairs and trigrams up by binary search; the
driver holds totals, discounts and file names only. Ids are dense and hashes no wider than two
ids, so sorted arrays differ by little and take few bytes; counts take a byte, and larger ones
stand in a list beside them. Tokens of a text are its words and one end; the first word's
context is a begin mark alone, which is never predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from . import text as T
from .common import arrow_map, fold, shared_dir

END = np.uint64(0x5851F42D4C957F2D)
#: Tokens gathered before a task's counts are sent on, and text bytes that one range stands for.
FLUSH, RANGE_BYTES, MOST_RANGE_BYTES = 2_000_000, 8 << 20, 512 << 20
_SHIFT = np.uint64(32)
_INV = (np.uint64(0x4F74430C22A54005), np.uint64(0x9CB4B2F8129337DB))


def mix(h: np.ndarray, half: int) -> np.ndarray:
    """A bijection of values of ``2 * half`` bits."""
    mask, half = np.uint64((1 << 2 * half) - 1), np.uint64(half)
    for k in (T.MIX[0], T.MIX[1]):
        h = (h ^ (h >> half)) * k & mask
    return h ^ (h >> half)


def unmix(h: np.ndarray, half: int) -> np.ndarray:
    """Inverse of ``mix``."""
    mask, half = np.uint64((1 << 2 * half) - 1), np.uint64(half)
    for k in (_INV[1], _INV[0]):
        h = (h ^ (h >> half)) * k & mask
    return h ^ (h >> half)


def _range_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> _SHIFT) * np.uint64(n) >> _SHIFT).astype(np.int64)


def _cuts(sorted_hashes: np.ndarray, n: int, bits: int = 64) -> np.ndarray:
    """Where each of ``n`` ranges begins in sorted hashes of so many bits, and the end."""
    return np.searchsorted(_range_of(sorted_hashes << np.uint64(64 - bits), n), np.arange(n + 1))


def _part_of(first: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The range that holds each id, by each range's first id; empty ranges hold none."""
    return np.searchsorted(first, ids, side="right") - 1


#: What a file's arrays may hold, and how many pairs share one entry of a file's directories.
_KINDS = ("u1", "<u4", "<u8")
_BLOCK = 16


def write_arrays(folder: str, name: str, *arrays: np.ndarray) -> str:
    """One file of arrays that know their kind and length, each at a multiple of eight bytes."""
    head = [len(arrays)]
    for a in arrays:
        head += [next(k for k, kind in enumerate(_KINDS) if np.dtype(kind) == a.dtype), len(a)]
    pads = [np.zeros(-a.nbytes % 8, np.uint8) for a in arrays]
    return store.write(folder, name, np.array(head, "<u8"), *[x for pair in zip(arrays, pads, strict=True) for x in pair])


def read_arrays(path: str) -> list[np.ndarray]:
    raw = store.mapped(path)
    n = int(raw[:8].view("<u8")[0])
    head, at, out = raw[8 : 8 + 16 * n].view("<u8").tolist(), 8 + 16 * n, []
    for kind, size in zip(head[::2], head[1::2], strict=True):
        b = size * np.dtype(_KINDS[kind]).itemsize
        out.append(raw[at : at + b].view(_KINDS[kind]))
        at += b + -b % 8
    return out


def small(v: np.ndarray) -> list[np.ndarray]:
    """Counts in a byte each; 255 stands for one that is listed with its place."""
    big = np.flatnonzero(v >= 255)
    return [np.minimum(v, 255).astype("u1"), big.astype("<u8"), v[big].astype("<u8")]


def pick(held: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """The counts at these places of what ``small`` gave."""
    low, places, large = held
    out = low[at].astype(np.int64)
    big = np.nonzero(out == 255)
    if len(big[0]):
        out[big] = large[np.searchsorted(places, at[big])]
    return out


def _within(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Place of each ``q`` in sorted ``values[lo:hi]``, or -1."""
    lo, end = lo.copy(), hi
    hi = hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        less = values[mid] < q[live]
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]
        live = live[lo[live] < hi[live]]
    out = np.full(len(q), -1, np.int64)
    can = np.flatnonzero(lo < end)
    hit = can[values[lo[can]] == q[can]]
    out[hit] = lo[hit]
    return out


def sequences(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, first token of each and the end, token hashes) over runs of whole rows; every row ends with END."""
    done = 0
    total = len(column)

    def bare(a: int, b: int):
        return np.arange(a, b), np.arange(b - a + 1), np.full(b - a, END)

    for rows, at, h in T.row_words(column):
        if rows[0] > done:
            yield bare(done, int(rows[0]))
        n = int(rows[-1] - rows[0]) + 1
        size = np.zeros(n, np.int64)
        size[rows - rows[0]] = np.diff(at)
        start = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(start[-1], END)
        keep = np.ones(start[-1], bool)
        keep[start[1:] - 1] = False
        out[keep] = h
        yield np.arange(rows[0], rows[-1] + 1), start, out
        done = int(rows[-1]) + 1
    if done < total:
        yield bare(done, total)


@dataclass(frozen=True)
class Files:
    """One file a range, and how many entries it has."""

    paths: tuple[str, ...]
    sizes: tuple[int, ...]

    def arrays(self, k: int, *kinds: str) -> list[np.ndarray]:
        raw, out, at = store.mapped(self.paths[k]), [], 0
        for kind in kinds:
            n = self.sizes[k] * np.dtype(kind).itemsize
            out.append(raw[at : at + n].view(kind))
            at += n
        return out


@dataclass(frozen=True)
class Model:
    words: Files
    pairs: Files
    lower: Files  # the pairs' counts in the lower order
    trigrams: Files  # by first pair; as many entries as pairs
    tails: Files
    first: tuple[int, ...]  # id of each word range's first word
    first_pair: tuple[int, ...]
    tokens: int
    vocabulary: int
    texts: int
    begin: tuple[int, int, int]  # words that follow the begin mark once, twice, oftener
    discounts: tuple[tuple[float, float, float], ...]  # of words, of pairs, of trigrams
    kinds: int  # different pairs
    cont_mass: float  # what words' discounts leave to the uniform distribution


def find_words(words: Files, first: tuple[int, ...], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id or -1, count) of each hash in sorted, distinct ``h``."""
    ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
    cut = _cuts(h, len(words.paths))
    for k in np.flatnonzero(np.diff(cut)):
        if words.sizes[k]:
            keys, c = words.arrays(k, "<u8", "<i8")
            q = h[cut[k] : cut[k + 1]]
            at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
            hit = keys[at] == q
            ids[cut[k] : cut[k + 1]] = np.where(hit, at + first[k], -1)
            counts[cut[k] : cut[k + 1]] = np.where(hit, c[at], 0)
    return ids, counts


def _pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    blob = store.pack(keys, *values)
    return len(blob).to_bytes(8, "little") + pa.compress(blob, codec="zstd", asbytes=True)


def _unpack(blob, values: int) -> list[np.ndarray]:
    return store.unpack(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), values)


def _send(cut: np.ndarray, keys: np.ndarray, *values: np.ndarray, tag: int = 0) -> list[tuple[int, int, bytes]]:
    """What each range gets: ``cut`` says where it begins."""
    return [(int(k), tag, _pack(keys[cut[k] : cut[k + 1]], *[v[cut[k] : cut[k + 1]] for v in values])) for k in np.flatnonzero(np.diff(cut))]


def _rows(sent: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, tag, blob = zip(*sent, strict=True) if sent else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(tag, pa.int32()), pa.array(blob, pa.binary())], names=["part", "tag", "blob"])


SENT = "part int, tag int, blob binary"


class _Gather:
    """Counts of hashes, merged now and then so that a task's memory is bounded."""

    def __init__(self, n: int, bits: int = 64):
        self.n, self.bits, self.held, self.size = n, bits, [], 0

    def add(self, h: np.ndarray) -> bool:
        self.held.append(h)
        self.size += len(h)
        return self.size >= FLUSH

    def flush(self) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(self.held) if self.held else np.zeros(0, np.uint64), return_counts=True)
        self.held, self.size = [], 0
        return _rows(_send(_cuts(keys, self.n, self.bits), keys, counts))


def _word_batches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Gather(n)
        for batch in batches:
            for _, _, h in sequences(batch.column("text")):
                if g.add(h):
                    yield g.flush()
        yield g.flush()

    return run


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, memoryview]]]]:
    """Blobs of each part; rows come sorted by part."""
    part, held = None, []
    for batch in batches:
        for p, t, b in zip(batch.column("part").to_pylist(), batch.column("tag").to_pylist(), batch.column("blob"), strict=True):
            if p != part and part is not None:
                yield part, held
                held = []
            part = p
            held.append((t, b.as_py()))
    if part is not None:
        yield part, held


def _merged(df: DataFrame, fn, schema: str) -> list:
    """Run ``fn`` over each part's blobs and collect its row of totals a part."""
    return arrow_map(df.repartition("part").sortWithinPartitions("part"), fn, schema).collect()


def _counted(blobs: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """Distinct sorted keys and their counts over all blobs."""
    got = [_unpack(b, 1) for _, b in blobs]
    return store.summed([g[0] for g in got], [[g[1] for g in got]])


def _many(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def _word_merge(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in _by_part(batches):
            keys, counts = _counted(blobs)
            path = store.write(folder, "words", keys.astype("<u8"), counts.astype("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["part", "path", "n", "total"])

    return run


def _half(vocabulary: int) -> int:
    """Bits of a word's id or the begin mark's, which is the vocabulary's size."""
    return max(1, vocabulary.bit_length())


def _pair_hashes(ids: np.ndarray, start: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(previous ids, hashes of the pairs) of a run of rows; unknown ids are -1, their pairs' hashes mean nothing."""
    half = _half(vocabulary)
    mask = np.uint64((1 << half) - 1)
    prev = np.empty(len(ids), np.int64)
    prev[1:] = ids[:-1]
    prev[start[:-1]] = vocabulary
    return prev, mix((prev.astype(np.uint64) & mask) << np.uint64(half) | ids.astype(np.uint64) & mask, half)


def _word_ids(words: Files, first: tuple[int, ...], h: np.ndarray) -> np.ndarray:
    u, inv = np.unique(h, return_inverse=True)
    return find_words(words, first, u)[0][inv]


def _pair_batches(words: Files, first: tuple[int, ...], vocabulary: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Gather(n, 2 * _half(vocabulary))
        for batch in batches:
            for _, start, h in sequences(batch.column("text")):
                if g.add(_pair_hashes(_word_ids(words, first, h), start, vocabulary)[1]):
                    yield g.flush()
        yield g.flush()

    return run


def _pair_arrays(keys: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Sorted hashes as low bits (32, or 64 where blocks are wide), with a directory of what the high bits are, and counts."""
    low, high = int(keys[0]), int(keys[-1])
    shift = max(0, ((high - low) * _BLOCK // len(keys)).bit_length() - 1)
    base = low >> shift
    starts = np.searchsorted((keys >> np.uint64(shift)) - np.uint64(base), np.arange((high >> shift) - base + 2, dtype=np.uint64))
    return [np.array([base, shift], "<u8"), starts.astype("<u4" if len(keys) < 1 << 32 else "<u8"), keys.astype("<u4" if shift <= 32 else "<u8"), *small(counts)]


def _pair_keys(arrays: list[np.ndarray]) -> np.ndarray:
    (base, shift), starts, low = arrays[0].tolist(), arrays[1], arrays[2]
    high = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64) + np.uint64(base), np.diff(starts.astype(np.int64))) << np.uint64(shift)
    keep = np.uint64((1 << shift) - 1)
    return high | low.astype(np.uint64) & keep


def _pair_merge(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in _by_part(batches):
            keys, counts = _counted(blobs)
            path = write_arrays(folder, "pairs", *_pair_arrays(keys, counts))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(keys)], pa.int64())], names=["part", "path", "n"])

    return run


def find_pairs(pairs: Files, first_pair: tuple[int, ...], h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(id or -1, count) of each hash in sorted, distinct ``h``."""
    ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
    cut = _cuts(h, len(pairs.paths), bits)
    for k in np.flatnonzero(np.diff(cut)):
        if not pairs.sizes[k]:
            continue
        about, starts, low, *held = read_arrays(pairs.paths[k])
        base, shift = about.tolist()
        q = h[cut[k] : cut[k + 1]]
        block = (q >> np.uint64(shift)).astype(np.int64) - base
        can = np.flatnonzero((block >= 0) & (block < len(starts) - 1))
        block = block[can]
        at = _within(low, starts[block].astype(np.int64), starts[block + 1].astype(np.int64), q[can].astype(low.dtype))
        hit = np.flatnonzero(at >= 0)
        ids[cut[k] + can[hit]] = at[hit] + first_pair[k]
        counts[cut[k] + can[hit]] = pick(held, at[hit])
    return ids, counts


def _trigram_batches(words: Files, first: tuple[int, ...], vocabulary: int, pairs: Files, first_pair: tuple[int, ...]):
    begins, bits = np.array(first_pair, np.int64), sum(pairs.sizes).bit_length()

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        if not held:
            return _rows([])
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        part = _part_of(begins, a)
        key = (a - begins[part]).astype(np.uint64) << np.uint64(bits) | b.astype(np.uint64)
        order = np.argsort(part, kind="stable")
        key, cut = key[order], np.searchsorted(part[order], np.arange(len(begins) + 1))
        return _rows([(int(k), 0, _pack(*np.unique(key[cut[k] : cut[k + 1]], return_counts=True))) for k in np.flatnonzero(np.diff(cut))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, start, h in sequences(batch.column("text")):
                u, inv = np.unique(_pair_hashes(_word_ids(words, first, h), start, vocabulary)[1], return_inverse=True)
                ids = find_pairs(pairs, first_pair, u, 2 * _half(vocabulary))[0][inv]
                second = np.ones(len(ids), bool)
                second[start[:-1]] = False
                at = np.flatnonzero(second)
                held.append((ids[at - 1], ids[at]))
                size += len(at)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        yield flush(held)

    return run


def _trigram_merge(folder: str, pairs: Files):
    bits = sum(pairs.sizes).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in _by_part(batches):
            keys, counts = _counted(blobs)
            n = -(-pairs.sizes[part] // _BLOCK) * _BLOCK
            before = (keys >> np.uint64(bits)).astype(np.int64)
            after = (keys & np.uint64((1 << bits) - 1)).astype("<u4" if bits <= 32 else "<u8")
            kinds, twice, more = (np.bincount(before[x], minlength=n) for x in (slice(None), counts == 2, counts > 2))
            starts = (np.cumsum(kinds) - kinds)[::_BLOCK].astype("<u8")
            path = write_arrays(folder, "trigrams", after, *small(counts), starts, *small(kinds), *small(twice), *small(more))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([_many(counts)], pa.list_(pa.int64()))], names=["part", "path", "many"])

    return run


def find_trigrams(model: Model, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, discount mass of what follows the first pair) of trigrams by their two pairs; a pair without id is -1."""
    count, mass = np.zeros(len(before), np.int64), np.zeros(len(before))
    first = np.array(model.first_pair, np.int64)
    part = np.where(before >= 0, _part_of(first, before), -1)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(len(first) + 1))
    d = model.discounts[2]
    for k in np.flatnonzero(np.diff(cut)):
        if not model.trigrams.paths[k]:
            continue
        here = order[cut[k] : cut[k + 1]]
        values, c0, c1, c2, starts, *by_pair = read_arrays(model.trigrams.paths[k])
        kinds, twice, more = by_pair[:3], by_pair[3:6], by_pair[6:]
        at = before[here] - first[k]
        block = at // _BLOCK
        sizes = kinds[0].reshape(-1, _BLOCK)[block].astype(np.int64)
        full = np.nonzero(sizes == 255)
        if len(full[0]):
            sizes[full] = pick(kinds, block[full[0]] * _BLOCK + full[1])
        lo = starts[block].astype(np.int64) + (sizes * (np.arange(_BLOCK) < (at % _BLOCK)[:, None])).sum(axis=1)
        n = sizes[np.arange(len(at)), at % _BLOCK]
        n2, n3 = pick(twice, at), pick(more, at)
        mass[here] = d[0] * (n - n2 - n3) + d[1] * n2 + d[2] * n3
        ask = np.flatnonzero(after[here] >= 0)
        place = _within(values, lo[ask], lo[ask] + n[ask], after[here[ask]].astype(values.dtype))
        hit = np.flatnonzero(place >= 0)
        count[here[ask[hit]]] = pick([c0, c1, c2], place[hit])
    return count, mass


def _lower_batches(trigrams: Files, first_pair: tuple[int, ...]):
    """What each file of trigrams says of second pairs; every range gets a word, if an empty one."""
    begins = np.array([*first_pair, sum(trigrams.sizes)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("part").to_pylist():
                if trigrams.sizes[k]:
                    yield _rows([(k, 0, _pack(np.zeros(0, np.uint64), np.zeros(0, np.int64)))])
                if trigrams.paths[k]:
                    ids, n = np.unique(read_arrays(trigrams.paths[k])[0], return_counts=True)
                    yield _rows(_send(np.searchsorted(ids, begins), ids.astype(np.uint64), n))

    return run


def _lower_merge(folder: str, pairs: Files, first_pair: tuple[int, ...], vocabulary: int):
    half = _half(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in _by_part(batches):
            arrays = read_arrays(pairs.paths[part])
            count = np.zeros(pairs.sizes[part], np.int64)
            for _, b in blobs:
                ids, n = _unpack(b, 1)
                count[ids.astype(np.int64) - first_pair[part]] += n
            at = np.flatnonzero(unmix(_pair_keys(arrays), half) >> np.uint64(half) == np.uint64(vocabulary))
            count[at] = pick(arrays[3:], at)
            path = write_arrays(folder, "lower", *small(count))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([_many(count)], pa.list_(pa.int64()))], names=["part", "path", "many"])

    return run


def _tail_batches(pairs: Files, lower: Files, first: tuple[int, ...], vocabulary: int):
    """What each pair file says of words: tag 0 the words before, tag 1 what follows."""
    begins, half = np.array(first, np.int64), _half(vocabulary)

    def send(ids: np.ndarray, tag: int, *values: np.ndarray) -> list[tuple[int, int, bytes]]:
        part = _part_of(begins, ids)
        part[ids == vocabulary] = len(begins)  # the begin mark
        return _send(np.searchsorted(part, np.arange(len(begins) + 2)), ids.astype(np.uint64), *values, tag=tag)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("part").to_pylist():
                if not pairs.sizes[k]:
                    continue
                key = unmix(_pair_keys(read_arrays(pairs.paths[k])), half)
                counts = pick(read_arrays(lower.paths[k]), np.arange(pairs.sizes[k]))
                ids, cont = np.unique((key & np.uint64((1 << half) - 1)).astype(np.int64), return_counts=True)
                yield _rows(send(ids, 0, cont))
                prev = (key >> np.uint64(half)).astype(np.int64)
                order = np.argsort(prev, kind="stable")
                prev, c = prev[order], counts[order]
                head = np.flatnonzero(np.append(True, prev[1:] != prev[:-1]))
                # after the begin mark there are as many words as texts, which need no sum
                yield _rows(send(prev[head], 1, *[np.add.reduceat(x.astype(np.int64), head) for x in (c == 1, c == 2, c > 2, np.where(prev == vocabulary, 0, c))]))

    return run


def _tail_merge(folder: str, first: tuple[int, ...], sizes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in _by_part(batches):
            base, n = (first[part], sizes[part]) if part < len(first) else (None, 1)
            cont, after = np.zeros(n, np.int64), np.zeros((4, n), np.int64)
            for tag, b in blobs:
                ids, *values = _unpack(b, 1 if tag == 0 else 4)
                at = ids.astype(np.int64) - base if base is not None else np.zeros(len(ids), np.int64)
                if tag == 0:
                    cont[at] += values[0]
                else:
                    after[:, at] += np.array(values)
            path = store.write(folder, "tails", after[3].astype("<u8"), cont.astype("<u4"), after[:3].astype("<u4"))
            top = after[:3, 0].tolist() if base is None else []
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([_many(cont)], pa.list_(pa.int64())), pa.array([int((cont > 2).sum())], pa.int64()), pa.array([top], pa.list_(pa.int64()))], names=["part", "path", "many", "more", "top"])

    return run


def discounts(many: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many entries have counts 1 to 4 (Chen and Goodman, 1998)."""
    n1, n2, n3, n4 = many
    if not n1 or not n2 or not n3:
        return 0.5, 0.75, 0.9  # too little to estimate from
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return tuple(float(min(k + 1, max(0.0, x))) for k, x in enumerate(d))


def _first(sizes: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(int(x) for x in np.concatenate([[0], np.cumsum(sizes)])[:-1])


def train(docs: DataFrame) -> Model:
    """Count the words, pairs and trigrams of all texts of ``docs`` (null: empty)."""
    spark = docs.sparkSession
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size, texts = text.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n = int(max(8, min(4096, -(-size // RANGE_BYTES)), -(-size // MOST_RANGE_BYTES)))
    folder = shared_dir(spark, "kneser-ney")
    parts = spark.range(n, numPartitions=min(n, 512)).select(F.col("id").cast("int").alias("part"))

    def merged(source: DataFrame, batches, merge, also: str) -> tuple[tuple[str, ...], dict]:
        """The file of each range, if it has any, and the ranges' totals."""
        got = {r.part: r for r in _merged(arrow_map(source, batches, SENT), merge, f"part int, path string, {also}")}
        return tuple(got[k].path if k in got else "" for k in range(n)), got

    def many(got: dict) -> list[int]:
        return [sum(r.many[k] for r in got.values()) for k in range(4)]

    paths, got = merged(text, _word_batches(n), _word_merge(folder), "n long, total long")
    words = Files(paths, tuple(got[k].n if k in got else 0 for k in range(n)))
    first, vocabulary, tokens = _first(words.sizes), sum(words.sizes), sum(r.total for r in got.values())
    if vocabulary >= (1 << 32) - 1:
        raise ValueError("2**32 or more different words and marks")
    paths, got = merged(text, _pair_batches(words, first, vocabulary, n), _pair_merge(folder), "n long")
    pairs = Files(paths, tuple(got[k].n if k in got else 0 for k in range(n)))
    first_pair, kinds = _first(pairs.sizes), sum(pairs.sizes)
    if max(pairs.sizes).bit_length() + kinds.bit_length() > 64:
        raise ValueError("more pairs than a trigram of two ids can tell apart in 64 bits")
    paths, got = merged(text, _trigram_batches(words, first, vocabulary, pairs, first_pair), _trigram_merge(folder, pairs), "many array<long>")
    trigrams, d_trigram = Files(paths, pairs.sizes), discounts(many(got))
    paths, got = merged(parts, _lower_batches(trigrams, first_pair), _lower_merge(folder, pairs, first_pair, vocabulary), "many array<long>")
    lower, d_pair = Files(paths, pairs.sizes), discounts(many(got))
    paths, got = merged(parts, _tail_batches(pairs, lower, first, vocabulary), _tail_merge(folder, first, words.sizes), "many array<long>, more long, top array<long>")
    begin = tuple(got.pop(n).top) if n in got else (0, 0, 0)
    seen = many(got)
    d_word = discounts(seen)
    more = sum(r.more for r in got.values())
    mass = (d_word[0] * seen[0] + d_word[1] * seen[1] + d_word[2] * more) / kinds if kinds else 1.0
    return Model(words, pairs, lower, trigrams, Files(paths, words.sizes), first, first_pair, tokens, vocabulary, texts, begin, (d_word, d_pair, d_trigram), kinds, mass)


def _lower_counts(model: Model, ids: np.ndarray) -> np.ndarray:
    """Counts in the lower order of sorted pair ids."""
    out = np.zeros(len(ids), np.int64)
    first = np.array(model.first_pair, np.int64)
    cut = np.searchsorted(_part_of(first, ids), np.arange(len(first) + 1))
    for k in np.flatnonzero(np.diff(cut)):
        out[cut[k] : cut[k + 1]] = pick(read_arrays(model.lower.paths[k]), ids[cut[k] : cut[k + 1]] - first[k])
    return out


def _discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)


def _tail(model: Model, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words before, discount mass of what follows, count of what follows) of sorted, distinct ids."""
    cont, mass, total = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    first = np.array(model.first, np.int64)
    cut = np.searchsorted(_part_of(first, ids), np.arange(len(first) + 1))
    d = model.discounts[1]
    for k in np.flatnonzero(np.diff(cut)):
        t, c, n1, n2, n3 = model.tails.arrays(k, "<u8", *["<u4"] * 4)
        here, at = slice(cut[k], cut[k + 1]), ids[cut[k] : cut[k + 1]] - first[k]
        cont[here], total[here] = c[at], t[at]
        mass[here] = d[0] * n1[at] + d[1] * n2[at] + d[2] * n3[at]
    return cont, mass, total


def token_scores(model: Model, start: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, base log10, model log10) of each token of a run of rows."""
    u, inv = np.unique(h, return_inverse=True)
    ids, count = find_words(model.words, model.first, u)
    v = model.vocabulary
    base = np.log10((count + 0.5) / (model.tokens + 0.5 * (v + 1)))
    known = np.flatnonzero(ids >= 0)  # ids rise with hashes
    cont, mass, after = np.zeros(len(u), np.int64), np.zeros(len(u)), np.zeros(len(u), np.int64)
    cont[known], mass[known], after[known] = _tail(model, ids[known])
    uniform = model.cont_mass / (v + 1) if model.kinds else 1.0 / (v + 1)
    p1 = _discounted(cont, model.discounts[0]) / max(model.kinds, 1) + uniform
    weight = np.where(after > 0, mass / np.maximum(after, 1), 1.0)  # of the lower order, after each word
    d, b = model.discounts[1], model.begin
    at_begin = np.zeros(len(h), bool)
    at_begin[start[:-1]] = True
    tid = ids[inv]
    prev, key = _pair_hashes(tid, start, v)
    total, back = np.empty(len(h)), np.empty(len(h))
    total[1:], back[1:] = after[inv[:-1]], weight[inv[:-1]]
    total[at_begin] = model.texts
    back[at_begin] = (d[0] * b[0] + d[1] * b[1] + d[2] * b[2]) / model.texts if model.texts else 1.0
    ask = np.flatnonzero((tid >= 0) & (prev >= 0))
    k, kinv = np.unique(key[ask], return_inverse=True)
    found, plain = find_pairs(model.pairs, model.first_pair, k, 2 * _half(v))
    pair, seen, times = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    pair[ask], times[ask] = found[kinv], plain[kinv]
    hit = np.flatnonzero(found >= 0)
    low = np.zeros(len(k), np.int64)
    low[hit] = _lower_counts(model, found[hit])  # ids rise with hashes
    seen[ask] = low[kinv]
    p = _discounted(seen, d) / np.maximum(total, 1) + back * p1[inv]
    at = np.flatnonzero(~at_begin)
    at = at[pair[at - 1] >= 0]  # the two words before were seen together
    c, left = find_trigrams(model, pair[at - 1], pair[at])
    p[at] = (_discounted(c, model.discounts[2]) + left * p[at]) / times[at - 1]
    return count[inv], base[inv], np.log10(p)


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
            base, score = np.zeros(n), np.zeros(n)
            for rows, start, h in sequences(batch.column("text")):
                c, b, s = token_scores(model, start, h)
                size[rows] = np.diff(start)
                known[rows] = np.add.reduceat(c > 0, start[:-1], dtype=np.int64)
                base[rows] = np.add.reduceat(b, start[:-1])
                score[rows] = np.add.reduceat(s, start[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(known), pa.array(np.full(n, model.tokens, np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Log10 probabilities of every whole text, by the model and by smoothed word counts.

    Null or empty text: one end token. One row per input row; extra columns are not carried.
    A model of no texts gives every token the uniform probability.
    """
    df = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = arrow_map(df, _score_batches(model), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", (F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).alias("perplexity"))


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Train on rows whose crc32(doc_id as text) mod 5 is not 1, score all rows.

    A null doc_id belongs to no fold: it is scored and not learned from.
    """
    held = fold(F.col("doc_id"), 5) == 1
    return score(docs, train(docs.where(~held)), held)
