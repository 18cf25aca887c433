"""Vectorised byte-level text helpers shared by the training-data operators.

Texts arrive as Arrow string columns; everything here works on their UTF-8 bytes.
A null text is an empty one. Words are runs of bytes outside ``\\x20\\x09-\\x0D`` with
A-Z lower-cased; a word never crosses a row. Blocks bound the memory of one step, and
only white space is cut, so a block's size never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))

WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = (LOWER.astype(np.uint64) + np.uint64(1))


#: Odd factors of ``mix``.
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * MIX[0]
    h = h ^ (h >> np.uint64(33))
    h = h * MIX[1]
    return h ^ (h >> np.uint64(33))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    pow = _powers(BLOCK + 4096, _R)
    inv = _powers(BLOCK + 4096, _R_INV)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.pow):
            size = 1 << int(n).bit_length()
            return _powers(size, _R), _powers(size, _R_INV)  # one huge word: not kept
        return cls.pow, cls.inv


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(buf: np.ndarray, offs: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most ``limit`` that cut rows only at white space; a longer word stays whole."""
    total, lo, k = len(buf), 0, 0
    while lo < total:
        k = int(np.searchsorted(offs, lo + limit, side="right")) - 1
        hi = int(offs[k])
        if hi <= lo:  # one row is longer than a block
            end, hi = int(offs[k + 1]), min(int(offs[k + 1]), lo + limit)
            if hi < end:
                back = np.flatnonzero(~WORD[buf[max(lo + 1, hi - 65536) : hi]])
                if len(back):
                    hi = max(lo + 1, hi - 65536) + int(back[-1]) + 1
                else:
                    step = 65536
                    while hi < end:
                        ahead = np.flatnonzero(~WORD[buf[hi : min(end, hi + step)]])
                        if len(ahead):
                            hi += int(ahead[0]) + 1
                            break
                        hi = min(end, hi + step)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """The words of one block: rows they belong to, byte ranges in ``data``, 64-bit hashes."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    sums: np.ndarray
    inv: np.ndarray

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, equal for equal lower-cased bytes."""
        return mix((self.sums[end] - self.sums[start]) * self.inv[start])


def words(column: pa.Array, limit: int = BLOCK) -> Iterator[Words]:
    """Blocks of words in row order; a row's words may come in several blocks."""
    buf, offs = utf8(column)
    for lo, hi in pieces(buf, offs, limit):
        b = buf[lo:hi]
        n = len(b)
        inside = WORD[b]
        first = np.zeros(n + 1, bool)
        edge = offs[(offs >= lo) & (offs <= hi)] - lo
        first[edge] = True
        first[[0, n]] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (first[:-1] | ~before))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (first[1:] | ~after)) + 1
        power, inv = _Tables.get(n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUE[b] * power[:n], out=sums[1:])
        row = np.searchsorted(offs, start + lo, side="right") - 1
        yield Words(row, start, end, mix((sums[end] - sums[start]) * inv[start]), b, sums, inv)


def runs(column: pa.Array, inside: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (row, start, end, bytes) of the runs of bytes in a class, in row order.

    ``inside`` says which bytes belong to a run; white space must not. Starts and ends are
    where the class changes between neighbouring bytes, or a row begins or ends.
    """
    buf, offs = utf8(column)
    for lo, hi in pieces(buf, offs, limit):
        b = buf[lo:hi]
        held = np.zeros(len(b) + 2, bool)
        held[1:-1] = inside[b]
        cut = np.zeros(len(b) + 1, bool)
        cut[offs[(offs >= lo) & (offs <= hi)] - lo] = True
        start = np.flatnonzero(held[1:] & (cut | ~held[:-1]))
        end = np.flatnonzero(held[:-1] & (cut | ~held[1:]))
        yield np.searchsorted(offs, start + lo, side="right") - 1, start, end, b


def row_words(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, first word of each, word hashes) of runs of whole rows; rows without words are left out.

    Rows are whole here: one row's hashes are held together (8 bytes a word).
    """
    held: list[np.ndarray] = []
    held_row = -1

    def flush():
        if held_row >= 0:
            h = np.concatenate(held)
            return np.array([held_row]), np.array([0, len(h)]), h
        return None

    for w in words(column, limit):
        if not len(w.row):
            continue
        if held_row >= 0 and w.row[0] != held_row:
            yield flush()
            held, held_row = [], -1
        last = w.row[-1]
        cut = int(np.searchsorted(w.row, last))
        h, r = w.hash, w.row
        if held_row >= 0:
            head = int(np.searchsorted(r, held_row, side="right"))
            held.append(h[:head])
            if head == len(r):
                continue
            yield flush()
            held, held_row = [], -1
            h, r, cut = h[head:], r[head:], max(0, cut - head)
        if cut:
            rows, at = np.unique(r[:cut], return_index=True)
            yield rows, np.append(at, cut), h[:cut]
        held, held_row = [h[cut:]], int(last)
    if held_row >= 0:
        yield flush()
