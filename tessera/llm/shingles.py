"""Jaccard join of word n-gram sets with token-combination prefixes.

A document's tokens are its distinct word n-grams, in the order of their hashes. Two sets of
Jaccard similarity t share at least k of their first ``n - ceil(t n) + k`` tokens, for every k.
A set with f frequent tokens in its prefix of k = f + 1 shares a rare one within it, so it is
indexed under the rare tokens of that extended prefix alone. Sets made of frequent tokens
almost only ("dense") are indexed under pairs of them: a prefix of k is dealt by hash into
k - 1 classes, so two dense sets share two tokens of one class.

Sets met under a key lie in chains of fitting sizes. Chains of the same sets, as the many keys
that near copies share, are one group. In a group, the parity of hashed tokens bounds the
overlap from above; edges of a spanning forest, likeliest first, are verified on the whole
sets. What stays in several components is met again with a finer parity map, and every set
hands its likeliest open partners to be verified, until none is left open. Equal sets are one
node from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .common import arrow_map, dropped, saved
from .components import components, smallest_reached
from .store import SortedLongs

#: A token in more sets than this is frequent.
FREQUENT = 1024
#: Sets of a group that are compared in one task; a larger group (of dense sets) is dealt in blocks.
BLOCK = 4096
#: Open partners that a set hands over in the first round of the finer map; each next one takes eight times as many.
PARTNERS = 8
#: Partners that are verified beside one copy of a set.
BESIDE = 1024
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its word n-grams); rows without words are left out."""
    for rows, at, h in T.row_words(column):
        for k, row in enumerate(rows):
            yield int(row), _shingles(h[at[k] : at[k + 1]], words)


def _shingles(h: np.ndarray, words: int) -> np.ndarray:
    size = min(words, len(h))
    n = len(h) - size + 1
    s = np.full(n, size, np.uint64)
    for k in range(size):
        s += h[k : k + n] * _K[k % len(_K)] + np.uint64(k // len(_K))
        if k >= len(_K) - 1:
            s = T.mix(s)
    return np.unique(T.mix(s))


class Prefixes:
    """Lengths of prefixes for a similarity of ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        #: two different sets that link have so many tokens at least
        self.smallest = -(-num // (den - num)) if den > num else 1 << 62

    def base(self, n):
        return n - -(-self.num * n // self.den)

    def most(self, n):
        """The largest k of the stored prefix; it grows with n."""
        return np.minimum(-(-self.num * n // self.den), 4 + n * (self.den - self.num) // (4 * self.den))

    def safe(self, n):
        """The largest k that every set of a fitting size stores too."""
        return self.most(-(-self.num * n // self.den))

    def labels(self, n: int) -> list[tuple[int, int]]:
        """(label, smallest size under it): two sets of fitting sizes have a label in common."""
        low, at, label = 1, 1, 0
        while True:
            up = at * self.den // self.num + 1
            if n < up:
                return [(label, low), (label + 1, at)]
            low, at, label = at, up, label + 1


def parity(s: np.ndarray, bits: int) -> bytes:
    """The parity of the number of tokens in each of ``bits`` bins; halves can be folded onto each other."""
    at = ((s >> np.uint64(17)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def _bits(n: int, per_token: int) -> int:
    return max(64, 1 << int(n * per_token - 1).bit_length())


def _signature_batches(words: int, prefixes: Prefixes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            f1, f2 = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            toks: list = [[]] * batch.num_rows
            sketch: list = [b""] * batch.num_rows
            for i, s in shingle_sets(batch.column("text"), words):
                n[i] = len(s)
                f1[i] = np.bitwise_xor.reduce(T.mix(s ^ _K[0])).view(np.int64)
                f2[i] = T.mix(s + _K[1]).sum(dtype=np.uint64).view(np.int64)
                if len(s) >= prefixes.smallest:
                    toks[i] = s[: prefixes.base(len(s)) + prefixes.most(len(s))].view(np.int64)
                    sketch[i] = parity(s, _bits(len(s), 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(f1), pa.array(f2), pa.array(toks, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "n", "f1", "f2", "toks", "sketch"],
            )

    return run


def _key_batches(prefixes: Prefixes, frequent: SortedLongs):
    """(key, node, n, dense) of each set: its rare tokens, and pairs of frequent ones if it is dense."""

    def pairs(n: int, t: np.ndarray, often: np.ndarray) -> np.ndarray:
        out = []
        for label, low in prefixes.labels(n):
            k = int(prefixes.most(np.int64(max(low, 1))))
            x = t[: prefixes.base(n) + k][often[: prefixes.base(n) + k]]
            mark = np.uint64(label) * _K[3] + _K[4]
            if k < 2:
                out.append(T.mix(x * _K[5] + mark))
                continue
            cls = T.mix(x ^ _K[6]) % np.uint64(k - 1)
            order = np.lexsort((x, cls))
            x, cls = x[order], cls[order]
            i, d = np.arange(len(x)), 1
            while True:
                i = i[i < len(x) - d]
                i = i[cls[i] == cls[i + d]]
                if not len(i):
                    break
                out.append(T.mix(x[i] * _K[5] + T.mix(x[i + d]) + mark))
                d += 1
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("toks")
            offs = np.asarray(lists.offsets).astype(np.int64)
            toks = np.asarray(lists.values)[offs[0] : offs[-1]]
            offs = offs - offs[0]
            node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            often = frequent.has(toks)
            before = np.append(0, np.cumsum(often))
            base, most = prefixes.base(n), np.diff(offs)
            some = np.flatnonzero(most > 0)
            use = most.copy()
            use[some] = base[some] + 1
            dense = np.zeros(len(n), bool)
            for r in some[before[offs[some] + use[some]] > before[offs[some]]]:
                ks = np.arange(1, int(prefixes.safe(n[r])) + 1)
                ks = ks[base[r] + ks <= most[r]]
                ok = before[offs[r] + base[r] + ks] - before[offs[r]] < ks
                dense[r] = not ok.any()
                use[r] = most[r] if dense[r] else base[r] + ks[np.argmax(ok)]
            row = np.repeat(np.arange(len(n)), np.diff(offs))
            take = (np.arange(len(toks)) - offs[row] < use[row]) & ~often
            key, of, kind = [toks[take]], [row[take]], [np.zeros(int(take.sum()), bool)]
            for r in np.flatnonzero(dense):
                s = slice(offs[r], offs[r + 1])
                x = pairs(int(n[r]), toks[s].view(np.uint64), often[s]).view(np.int64)
                key.append(x)
                of.append(np.full(len(x), r))
                kind.append(np.ones(len(x), bool))
            of = np.concatenate(of)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(node[of]), pa.array(n[of]), pa.array(np.concatenate(kind))], names=["key", "node", "n", "dense"])

    return run


def _whole_groups(work: Callable[[pa.Table], pa.RecordBatch], by: str, rows: int, size: int = 64 << 20):
    """``work`` over tables that hold whole groups; rows come sorted by ``by``, and groups may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = bytes_ = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            bytes_ += batch.nbytes
            if n >= rows or bytes_ >= size:
                t = pa.Table.from_batches(held)
                g = t.column(by).to_numpy()
                cut = int(np.searchsorted(g, g[-1])) if g[0] != g[-1] else 0
                if cut:  # the last group may go on
                    yield work(t.slice(0, cut).combine_chunks())
                    rest = t.slice(cut).combine_chunks()
                    held, n, bytes_ = rest.to_batches(), rest.num_rows, rest.nbytes
        if n:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run


def _chain_batches(num: int, den: int, rows: int = 200_000):
    """(g, node, n) of chains of fitting sizes under one key; g stands for a chain's sets, whatever the key.

    Chains that a task has met before are left out (a cache of bounded size; what it forgets
    comes again and falls together in the shuffle).
    """
    met: set[int] = set()

    def work(t: pa.Table) -> pa.RecordBatch:
        key, node, n = (t.column(c).to_numpy() for c in ("key", "node", "n"))
        new = (key[1:] != key[:-1]) | (num * n[1:] > den * n[:-1])
        head = np.flatnonzero(np.append(True, new))
        count = np.diff(np.append(head, len(key)))
        sig = (T.mix(np.add.reduceat(T.mix(node.astype(np.uint64) + _K[2]), head)) + count.astype(np.uint64)).view(np.int64)
        some = np.flatnonzero(count > 1)
        _, first = np.unique(sig[some], return_index=True)
        some = some[np.sort(first)]
        some = some[np.array([x not in met for x in sig[some].tolist()], bool)]
        if len(met) > 1 << 20:
            met.clear()
        met.update(sig[some].tolist())
        keep = np.zeros(len(head), bool)
        keep[some] = True
        at = np.repeat(keep, count)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(sig, count)[at]), pa.array(node[at]), pa.array(n[at])], names=["g", "node", "n"])

    return _whole_groups(work, "key", rows)


def spanning_forest(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Indices of the edges of a maximum spanning forest (over rows, or over what ``label`` joins already)."""
    lab = np.arange(n) if label is None else label
    order = np.argsort(-weight, kind="stable")
    chosen, left = [], order
    i, j, rank = i[order], j[order], np.arange(len(order))
    while True:
        open_ = lab[i] != lab[j]
        i, j, rank = i[open_], j[open_], rank[open_]
        if not len(i):
            return left[np.unique(np.concatenate(chosen))] if chosen else np.zeros(0, np.int64)
        best = np.full(n, len(left))
        np.minimum.at(best, lab[i], rank)
        np.minimum.at(best, lab[j], rank)
        pick = np.unique(best[best < len(left)])
        at = np.searchsorted(rank, pick)
        chosen.append(pick)
        lab = smallest_reached(n, i[at], j[at], lab)


def _fitting(t: pa.Table, num: int, den: int, comp: np.ndarray | None, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bound) of the pairs of rows whose parity maps allow the similarity, outside one component.

    Rows come sorted by g and n. Maps of two sizes are compared in the smaller one.
    """
    g, node, n = (t.column(c).to_numpy() for c in ("g", "node", "n"))
    maps = t.column("sketch").to_pylist()
    size = np.array([len(m) for m in maps], np.int64)
    for width in np.unique(size[size > 0]):
        at = np.flatnonzero((size == width) | (size == 2 * width))
        x = np.zeros((len(at), width // 8), np.uint64)
        for k, r in enumerate(at):
            v = np.frombuffer(maps[r], np.uint64)
            x[k] = v if size[r] == width else v[: width // 8] ^ v[width // 8 :]
        gs, ns, cs, nodes = g[at], n[at], comp[at] if comp is not None else None, node[at]
        live, d = np.flatnonzero(size[at] == width), 1
        while True:
            live = live[live < len(at) - d]
            j = live + d
            live = live[(gs[live] == gs[j]) & (num * ns[j] <= den * ns[live])]
            if not len(live):
                break
            some = live[nodes[live] != nodes[live + d]] if cs is None else live[cs[live] != cs[live + d]]
            for i in np.array_split(some, -(-len(some) * x.shape[1] // cells) or 1):
                j = i + d
                apart = np.bitwise_count(x[i] ^ x[j]).sum(1, dtype=np.int64)
                most = np.minimum((ns[i] + ns[j] - apart) // 2, ns[i])
                ok = den * most >= num * (ns[i] + ns[j] - most)
                if ok.any():
                    i, j, most = i[ok], j[ok], most[ok]
                    yield at[i], at[j], most / (ns[i] + ns[j] - most)
            d += 1


def _edges(a: np.ndarray, b: np.ndarray, more: bool = False) -> pa.RecordBatch:
    """Distinct pairs, smaller end first; a row of nulls says that more are open."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    ends = [pa.array(x[first], pa.int64()) for x in (a, b)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([x, pa.nulls(int(more), pa.int64())]) for x in ends], names=["a", "b"])


def _forest_batches(num: int, den: int, rows: int = 60_000, hold: int = 500_000):
    """Edges of spanning forests of the pairs that could link, likeliest first, of each run of groups."""

    def work(t: pa.Table) -> pa.RecordBatch:
        ids, at = np.unique(t.column("node").to_numpy(), return_inverse=True)
        i, j, w = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        held: list = []

        def less() -> None:
            nonlocal i, j, w, held
            i, j, w = (np.concatenate([x, *y]) for x, y in zip((i, j, w), zip(*held, strict=True), strict=True)) if held else (i, j, w)
            k = spanning_forest(len(ids), i, j, w)
            i, j, w, held = i[k], j[k], w[k], []

        for x, y, bound in _fitting(t, num, den, None):
            held.append((at[x], at[y], bound))
            if sum(len(h[0]) for h in held) > hold:
                less()
        less()
        return _edges(ids[i], ids[j])

    return _whole_groups(work, "g", rows)


def _open_batches(num: int, den: int, partners: int, rows: int = 60_000, hold: int = 500_000):
    """Each set's likeliest partners outside its component that were not tried; nulls if there are more."""

    def work(t: pa.Table) -> pa.RecordBatch:
        node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
        lists = t.column("tried").combine_chunks() if isinstance(t.column("tried"), pa.ChunkedArray) else t.column("tried")
        offs = np.asarray(lists.offsets)
        other = np.asarray(lists.values)[offs[0] : offs[-1]]
        tried = np.unique(T.mix(np.repeat(node, np.diff(offs)).astype(np.uint64)) ^ (other.astype(np.uint64) * _K[0]))
        a, b, w, more = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), False
        held: list = []

        def less() -> None:
            nonlocal a, b, w, held, more
            if held:
                a, b, w = (np.concatenate([x, *y]) for x, y in zip((a, b, w), zip(*held, strict=True), strict=True))
            order = np.lexsort((b, a, -w))
            a, b, w, held = a[order], b[order], w[order], []
            _, first = np.unique(np.stack([a, b]), axis=1, return_index=True)
            first = np.sort(first)
            a, b, w = a[first], b[first], w[first]
            keep = np.zeros(len(a), bool)
            for end in (a, b):
                order = np.argsort(end, kind="stable")
                head = np.append(True, end[order][1:] != end[order][:-1]) if len(a) else np.zeros(0, bool)
                nth = np.arange(len(a)) - np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
                keep[order[nth < partners]] = True
            more |= not keep.all()
            a, b, w = a[keep], b[keep], w[keep]

        for i, j, bound in _fitting(t, num, den, comp):
            x, y = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            ok = ~np.isin(T.mix(x.astype(np.uint64)) ^ (y.astype(np.uint64) * _K[0]), tried)
            held.append((x[ok], y[ok], bound[ok]))
            if sum(len(h[0]) for h in held) > hold:
                less()
        less()
        return _edges(a, b, more)

    return _whole_groups(work, "g", rows)


def _text_batches(words: int, some: SortedLongs):
    """Texts of the given documents as compressed bytes (hashes of their shingles would be larger), with fine parity maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(some.has(batch.column("doc_id").to_numpy())))
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            n, maps = np.zeros(len(raw), np.int64), [b""] * len(raw)
            for i, s in shingle_sets(batch.column("text"), words):
                n[i], maps[i] = len(s), parity(s, _bits(len(s), 8))
            blobs = [pa.compress(t, codec="zstd", asbytes=True) for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(maps, pa.binary()), pa.array([len(t) for t in raw], pa.int64()), pa.array(blobs, pa.binary())], names=["node", "n", "sketch", "size", "blob"])

    return run


def _verify_batches(words: int, num: int, den: int, rows: int = 32):
    """Whether pairs' whole sets are similar enough; rows come by g, the set in the middle before its partners."""

    def similar(p: np.ndarray, q: np.ndarray) -> bool:
        same = len(np.intersect1d(p, q, assume_unique=True))
        return den * same >= num * (len(p) + len(q) - same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            a, b, links = [], [], []
            for k in range(0, batch.num_rows, rows):
                some = batch.slice(k, rows)
                texts = [pa.decompress(x.as_buffer(), n, codec="zstd", asbytes=True) for n, x in zip(some.column("size").to_pylist(), some.column("blob"), strict=True)]
                sets = [np.zeros(0, np.uint64)] * len(texts)
                for i, s in shingle_sets(pa.array(texts, pa.large_binary()), words):
                    sets[i] = s
                for g, middle, node, s in zip(some.column("g").to_pylist(), some.column("middle").to_pylist(), some.column("node").to_pylist(), sets, strict=True):
                    if (g, middle) != at:
                        at, held = (g, middle), []
                    if node == middle:
                        held.append(s)
                    else:
                        a.append(middle)
                        b.append(node)
                        links.append(any(similar(p, s) for p in held))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.bool_())], names=["a", "b", "links"])

    return run


class JaccardJoin:
    """Links between documents whose word n-gram sets have similarity ``num / den`` or more."""

    def __init__(self, docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, frequent: int = FREQUENT):
        self.words, self.num, self.den, self.frequent = words, num, den, frequent
        self.prefixes = Prefixes(num, den)
        self.docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        schema = "doc_id long, n long, f1 long, f2 long, toks array<long>, sketch binary"
        signed = saved(arrow_map(self.docs, _signature_batches(words, self.prefixes), schema), "signatures")
        sets = signed.where("n > 0 and doc_id is not null")
        self.nodes = saved(sets.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("node"), F.first("toks").alias("toks"), F.first("sketch").alias("sketch")), "nodes")
        own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node"))
        self.rows = saved(signed.select("doc_id", "n", "f1", "f2").join(self.nodes.select("n", "f1", "f2", "node"), ["n", "f1", "f2"], "left").select("doc_id", "n", own.alias("node")), "rows")
        dropped(signed)

    def groups(self) -> DataFrame:
        """(g, node, n): groups of sets, within which all pairs that could link meet somewhere."""
        sets = self.nodes.where("size(toks) > 0")
        count = sets.select(F.explode("toks").alias("key")).groupBy("key").agg(F.count("*").alias("c"))
        often = saved(count.where(F.col("c") > self.frequent).select("key"), "frequent")
        keys = arrow_map(sets.select("node", "n", "toks"), _key_batches(self.prefixes, SortedLongs(often, "frequent-keys")), "key long, node long, n long, dense boolean")
        chains = arrow_map(keys.select("key", "n", "node").repartition("key").sortWithinPartitions("key", "n", "node"), _chain_batches(self.num, self.den), "g long, node long, n long")
        out = saved(chains.distinct(), "groups")
        large = out.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select("g", F.ceil(F.col("c") / BLOCK).cast("int").alias("s"))
        large = saved(large, "large")
        if large.count():
            at = out.join(large, "g").withColumn("p", F.pmod(F.xxhash64("node"), F.col("s")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
            dealt = at.select(F.xxhash64("g", F.least("p", "q"), F.greatest("p", "q")).alias("g"), "node", "n")
            whole = out
            out = saved(whole.join(large, "g", "left_anti").unionByName(dealt), "groups")
            dropped(whole)
        for t in (often, large):
            dropped(t)
        return out

    def _verified(self, edges: DataFrame, texts: DataFrame) -> DataFrame:
        """(a, b, links): whether (saved) edges link. A set goes to its partners, and once to every ``BESIDE`` of them."""
        parts = max(1, edges.count() // BESIDE)
        at = edges.select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(parts))).alias("g"), "a", "b")
        place = at.select("g", F.col("a").alias("middle"), F.col("b").alias("node")).unionByName(at.select("g", F.col("a").alias("middle"), F.col("a").alias("node")).distinct())
        rows = texts.select("node", "size", "blob").join(place, "node").withColumn("kind", F.col("node") != F.col("middle"))
        rows = rows.repartition("g").sortWithinPartitions("g", "middle", "kind").select("g", "middle", "node", "size", "blob")
        return saved(arrow_map(rows, _verify_batches(self.words, self.num, self.den), "a long, b long, links boolean"), "links")

    def _same_document(self) -> DataFrame | None:
        """Edges between the sets of a doc_id that comes with several texts."""
        several = saved(self.rows.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("doc_id"), "several")
        found = several.count()
        edges = saved(self.rows.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"), F.lit(True).alias("links")), "links") if found else None
        dropped(several)
        return edges

    def node_components(self) -> DataFrame:
        """(node, component) of the nodes that have links."""
        checked = [x for x in [self._same_document()] if x is not None]
        groups = self.groups()
        sketched = groups.select("g", "node").join(self.nodes.select("node", "n", "sketch"), "node")
        first = arrow_map(sketched.repartition("g").sortWithinPartitions("g", "n", "node").select("g", "node", "n", "sketch"), _forest_batches(self.num, self.den), "a long, b long")
        edges = saved(first.distinct(), "edges")
        ends = saved(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct(), "ends")
        texts = saved(arrow_map(self.docs.where("doc_id is not null"), _text_batches(self.words, SortedLongs(ends, "end-nodes")), "node long, n long, sketch binary, size long, blob binary"), "texts")
        dropped(ends)
        partners = PARTNERS
        checked.append(self._verified(edges, texts))
        while True:
            done = _union(checked)
            comp = components(done.where("links"))
            tried = done.where("not links").groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("tried"))
            info = texts.select("node", "n", "sketch").join(comp, "node", "left").join(tried, "node", "left")
            info = info.select("node", "n", "sketch", F.coalesce("component", "node").alias("comp"), F.coalesce("tried", F.array().cast("array<long>")).alias("tried"))
            rows = groups.select("g", "node").join(info, "node").repartition("g").sortWithinPartitions("g", "n", "node").select("g", "node", "n", "sketch", "comp", "tried")
            found = saved(arrow_map(rows, _open_batches(self.num, self.den, partners), "a long, b long").distinct(), "open")
            more = found.where("a is null").count()
            found = found.where("a is not null")
            if not found.count():
                break
            checked.append(self._verified(found, texts))
            dropped(comp)
            if not more:
                comp = components(_union(checked).where("links"))
                break
            partners *= 8
        for t in (groups, texts):
            dropped(t)
        return comp

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        comp = self.node_components()
        dropped(self.nodes)
        return self.rows.join(comp, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, frequent: int = FREQUENT) -> DataFrame:
    """Every document's set size and the smallest doc_id reachable by links.

    A document's set is its distinct ``words``-word shingles (its whole sequence if shorter);
    two link when ``den * |intersection| >= num * |union|``. Null texts and texts without
    words have no set and link with nothing; a null doc_id gets a null component. Rows with
    one doc_id are one document: it links as any of them does. Extra columns are not carried.
    Empty table: no rows.
    """
    return JaccardJoin(docs, words, num, den, frequent).result()


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, one for each component: its smallest doc_id; rows without id all stay.

    Of repeated rows of one doc_id the first by text stays.
    """
    comp = saved(jaccard_components(docs, words, num, den).select("doc_id", "component_id"), "groups")
    again = comp.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null").select("doc_id")
    lost = comp.where("doc_id <> component_id").select("doc_id").distinct()
    # few rows leave or come twice: their ids are joined with, not those of all that stay
    kept = docs.join(lost.unionByName(again).distinct(), "doc_id", "left_anti")
    nth = "_nth"
    while nth in (c.lower() for c in docs.columns):
        nth += "_"
    rank = Window.partitionBy("doc_id").orderBy("text")
    first = docs.join(again, "doc_id", "left_semi").join(lost, "doc_id", "left_anti").withColumn(nth, F.row_number().over(rank)).where(F.col(nth) == 1).drop(nth)
    return kept.unionByName(first).select(docs.columns)
