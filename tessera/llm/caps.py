"""Near-duplicate embeddings by spherical-cap filters.

Unit vectors are rotated and cut in blocks; each block has a random code of unit vectors,
and every choice of one codeword a block is a filter direction (a structured random product
code). A vector goes to all filters whose inner product with it reaches ``alpha`` (its caps),
found from the blocks' scores alone. Vectors that meet in a filter are verified by their
cosine in double precision. A pair is counted in the first filter that both have, so counts
need no list of pairs; edges within a task shrink to a spanning forest before they leave it.
Equal vectors of one label are one node, with a multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, saved
from .components import components, smallest_reached

#: Codes, codewords a block, blocks, and the caps' height in standard deviations of a random
#: vector's inner product. At 64 dimensions a vector has about 21 caps; about 1 in 100 pairs
#: of cosine 0.93 share none, 1 in 1000 of cosine 0.99.
CODES, CODEWORDS, BLOCKS, HEIGHT = 20, 32, 2, 3.0
#: Rows of a filter that are compared in one group; larger filters are dealt out in blocks.
BLOCK_ROWS = 4096


@lru_cache(maxsize=256)
def _code(dim: int, codewords: int, blocks: int, nth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation, and each block's unit codewords."""
    rng = np.random.default_rng([dim, nth])
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    codes = []
    for part in np.array_split(np.arange(dim), min(blocks, dim)):
        c = rng.normal(size=(codewords, len(part)))
        codes.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return turn, codes


def list_decode(unit: np.ndarray, nth: int = 0, codewords: int = CODEWORDS, blocks: int = BLOCKS, height: float = HEIGHT) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter whose direction has an inner product of ``height / sqrt(dim)`` or more.

    Partial choices are kept while the best codewords of the blocks to come can still lift
    them to the cap.
    """
    dim = unit.shape[1]
    turn, codes = _code(dim, codewords, blocks, nth)
    x = unit @ turn
    parts = np.split(x, np.cumsum([c.shape[1] for c in codes])[:-1], axis=1)
    scores = [p @ c.T / len(codes) ** 0.5 for p, c in zip(parts, codes, strict=True)]
    need = min(height / dim**0.5, 0.55)  # in few dimensions a cap must stay wide enough to be met
    rest = np.zeros((len(unit), len(codes) + 1))
    for k in range(len(codes) - 1, -1, -1):
        rest[:, k] = rest[:, k + 1] + scores[k].max(1)
    row, code, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for k, s in enumerate(scores):
        out = []
        for a in range(0, len(row), 4096):
            r = row[a : a + 4096]
            t = total[a : a + 4096, None] + s[r]
            i, j = np.nonzero(t + rest[r, k + 1][:, None] >= need - 1e-12)
            out.append((r[i], code[a : a + 4096][i] * codewords + j, t[i, j]))
        row, code, total = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (row[:0], code[:0], total[:0])
    return row, code + nth * codewords ** len(codes)


def caps(x: np.ndarray, codes: int = CODES, codewords: int = CODEWORDS, blocks: int = BLOCKS, height: float = HEIGHT) -> list[np.ndarray]:
    """Sorted filters of each vector, over all codes."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    row, code = (np.concatenate(c) for c in zip(*(list_decode(unit, k, codewords, blocks, height) for k in range(codes)), strict=True))
    order = np.lexsort((code, row))
    return np.split(code[order], np.searchsorted(row[order], np.arange(1, len(x))))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def _decode_batches(**code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column("dim"))
            for dim in np.unique(size):
                some = batch.filter(pa.array(size == dim))
                lists = caps(_vectors(some.column("v"), int(dim)), **code)
                yield pa.RecordBatch.from_arrays([some.column("node"), some.column("key"), some.column("mult"), some.column("v"), pa.array(lists, pa.list_(pa.int32()))], names=["node", "key", "mult", "v", "filters"])

    return run


def _share_earlier(lists: np.ndarray, i: np.ndarray, j: np.ndarray, filt: np.ndarray, cells: int = 1 << 24) -> np.ndarray:
    """Whether rows ``i`` and ``j`` of the sorted, -1-padded lists share a value below ``filt``."""
    k = max(1, int(max(((lists[r] < filt[:, None]) & (lists[r] >= 0)).sum(1).max() for r in (i, j))))
    out = np.zeros(len(i), bool)
    for c in np.array_split(np.arange(len(i)), -(-len(i) * k * k // cells)):
        a, b, f = lists[i[c], :k], lists[j[c], :k], filt[c][:, None]
        a = np.where((a < f) & (a >= 0), a, -1)
        b = np.where((b < f) & (b >= 0), b, -2)
        out[c] = (a[:, :, None] == b[:, None, :]).any((1, 2))
    return out


def _link_batches(least: float, gather: int = 20_000, chunk: int = 16_384):
    def links(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        g, key, filt, side, node, mult, split = (t.column(c).to_numpy() for c in ("g", "key", "filter", "side", "node", "mult", "split"))
        lists = t.column("filters").combine_chunks()
        offs = np.asarray(lists.offsets)
        flat = np.asarray(lists.values)
        v = t.column("v").combine_chunks()
        v_offs, v_flat = np.asarray(v.offsets), np.asarray(v.values, np.float64)
        n = len(g)
        size = np.diff(v_offs)
        dim = int(size.max()) if n else 0
        x = np.zeros((n, dim))
        x[np.arange(dim)[None, :] < size[:, None]] = v_flat[v_offs[0] : v_offs[-1]]
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        wide = int(np.diff(offs).max()) if n else 0
        lst = np.full((n, wide), -1, np.int32)
        lst[np.arange(wide)[None, :] < np.diff(offs)[:, None]] = flat[offs[0] : offs[-1]]
        count = np.zeros(n, np.int64)
        li, lj = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        held = 0
        live, d = np.arange(max(0, n - 1)), 1
        while True:
            live = live[live < n - d]
            live = live[g[live] == g[live + d]]
            if not len(live):
                break
            for i in np.array_split(live, -(-len(live) // chunk)):
                j = i + d
                ok = (key[i] == key[j]) & (filt[i] == filt[j]) & (~split[i] | (side[i] != side[j]))
                i, j = i[ok], j[ok]
                ok = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= least
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                earlier = _share_earlier(lst, i, j, filt[i])
                i, j = i[~earlier], j[~earlier]
                np.add.at(count, i, mult[j])
                np.add.at(count, j, mult[i])
                li.append(i)
                lj.append(j)
                held += len(i)
                if held > 500_000:
                    lab = smallest_reached(n, np.concatenate(li), np.concatenate(lj))
                    k = np.flatnonzero(lab != np.arange(n))
                    li, lj, held = [k], [lab[k]], 0
            d += 1
        lab = smallest_reached(n, np.concatenate(li), np.concatenate(lj))
        k = np.flatnonzero((count > 0) | (lab != np.arange(n)))
        return pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(count[k]), pa.array(node[lab[k]])], names=["node", "n", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= gather:
                t = pa.Table.from_batches(held)
                g = t.column("g").to_numpy()
                cut = int(np.searchsorted(g, g[-1])) if g[0] != g[-1] else 0
                if cut:
                    yield links(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    rows -= cut
        if rows:
            yield links(pa.Table.from_batches(held))

    return run


def near_duplicates(rows: DataFrame, least: float = 0.93, block_rows: int = BLOCK_ROWS, **code) -> DataFrame:
    """Links between vectors of equal, non-null label with a cosine of ``least`` or more.

    Takes vec_id, embedding, label. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of another length. Repeated rows
    of one vec_id are one vector. Returns vec_id, n_links, component_id, kept, a row for each
    input row; a null vec_id gets a null component and is not kept. Extra columns are not
    carried. Empty table: no rows.
    """
    v = F.col("embedding").cast("array<float>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda c: c != 0)
    base = rows.select(F.col("vec_id").cast("long"), v.alias("v"), F.xxhash64(F.col("label").cast("string"), F.size(v)).alias("key"), F.coalesce(sound, F.lit(False)).alias("sound"))
    good = base.where("sound").select("vec_id", "v", "key")
    nodes = saved(good.distinct().groupBy("key", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult")).select("node", "key", "mult", "v", F.size("v").alias("dim")), "nodes")
    listed = saved(arrow_map(nodes, _decode_batches(**code), "node long, key long, mult long, v array<float>, filters array<int>"), "caps")
    each = listed.select("node", "key", F.explode("filters").alias("filter"))
    met = each.groupBy("key", "filter").agg(F.count("*").alias("c")).where("c > 1").withColumn("s", F.ceil(F.col("c") / block_rows).cast("int")).drop("c")
    each = each.join(met, ["key", "filter"]).withColumn("side", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
    each = each.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).withColumn("lo", F.least("side", "q")).withColumn("hi", F.greatest("side", "q"))
    each = each.select("node", "filter", "side", (F.col("lo") < F.col("hi")).alias("split"), F.xxhash64("key", "filter", "lo", "hi").alias("g"))
    full = each.join(listed, "node").repartition("g").sortWithinPartitions("g", "node").select("g", "key", "filter", "side", "split", "node", "mult", "v", "filters")
    links = saved(arrow_map(full, _link_batches(least), "node long, n long, to long"), "links")
    comp = components(links.select(F.col("node").alias("a"), F.col("to").alias("b")))
    count = links.groupBy("node").agg(F.sum("n").alias("n"))
    done = nodes.select("node", "key", "mult", "v").join(count, "node", "left").join(comp, "node", "left").select("key", "v", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("c"))
    # a vector's hash stands for it in the join's key; the vectors themselves are compared too
    one = base.where("sound").withColumn("h", F.xxhash64("key", "v")).join(done.withColumn("h", F.xxhash64("key", "v")).withColumnRenamed("key", "k2").withColumnRenamed("v", "v2"), "h").where("key = k2 and v = v2").select("vec_id", "n_links", F.col("c").alias("component_id"))
    none = base.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return one.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
