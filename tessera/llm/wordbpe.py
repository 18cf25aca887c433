"""BPE with word ends, by forced boundaries: cuts that no token of the vocabulary can span.

A merge only ever builds a token of the vocabulary. So if two bytes never stand side by side
inside any token, no merge joins them wherever they meet: the place is a certain cut, and a
word's encoding is the encodings of its fragments put one after the other.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import arrow_map

#: Segments and words that a worker remembers, in each of two generations, and the longest of them.
MEMO, MEMO_CHARS = 250_000, 64
#: Segments that go through the library's normalisation and split together.
TOGETHER = 1024
#: Fragments up to this length are merged many at once, longer ones by themselves; and how many at once.
SHORT, MANY = 48, 8192
UNRANKED = np.int32(1 << 30)


class Memo(dict):
    """Key -> ``make(key)``; the older of two generations goes when the newer is full, long keys are not kept."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.turn()
            self[key] = out
        return out

    def keep_all(self, made: dict) -> None:
        """The texts of one block more, at most."""
        if len(self) + len(made) > MEMO:
            self.turn()
        if max(map(len, made), default=0) > MEMO_CHARS:
            made = {k: v for k, v in made.items() if len(k) <= MEMO_CHARS}
        self.update(made)

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


class WordBpe:
    """Ranks, ids and forced boundaries of one tokenizer file.

    Normalisation and the split into words are the library's, called on segments; merging is ours.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.id, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        bare = (t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) and len(t) > len(self.suffix) else t for t in self.id)
        #: Byte pairs that stand inside some token; every other pair is a forced boundary.
        self.joined = {t[k : k + 2] for t in bare for k in range(len(t) - 1)}
        self.word = Memo(lambda w: self.encode_words([w])[0])
        self.segment = Memo(self.encode_segment)

        # The same as arrays: symbols of characters inside and at the end of a word, pairs by key, what a rank makes.
        base = sorted({c for t in self.id for c in t} & {t for t in self.id if len(t) == 1})
        self.inner, self.last, self.place = (np.full(max(map(ord, base)) + 1, -1, np.int64) for _ in range(3))
        for k, c in enumerate(base):
            self.inner[ord(c)], self.last[ord(c)], self.place[ord(c)] = self.id[c], self.id.get(c + self.suffix, -1), k
        self.inside = np.zeros((len(base), len(base)), bool)
        at = {c: k for k, c in enumerate(base)}
        for a, b in self.joined:
            if a in at and b in at:
                self.inside[at[a], at[b]] = True
        self.made = np.array([self.id[a + b] for a, b in pairs], np.int64)
        key = np.array([self.id[a] << 20 | self.id[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)
        names = sorted(self.id, key=self.id.get)
        if [self.id[t] for t in names] != list(range(len(names))):
            raise ValueError("the vocabulary's ids have gaps")
        self.names, self.numbers = pa.array(names, pa.large_string()), pa.array([str(k) for k in range(len(names))], pa.large_string())

    def fragments(self, word: str) -> list[str]:
        """The word (one character a byte) cut at its forced boundaries; the last fragment carries the word end."""
        joined = self.joined
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in joined]
        out = [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]
        out[-1] += self.suffix
        return out

    def merge(self, fragment: str) -> list[int]:
        """Ids of one fragment: the pair of lowest rank is merged first, the leftmost among equals; by a heap."""
        end = self.suffix if self.suffix and fragment.endswith(self.suffix) and len(fragment) > len(self.suffix) else ""
        sym: list[str | None] = list(fragment[: len(fragment) - len(end)])
        sym[-1] += end
        n, rank = len(sym), self.rank
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(agenda)
        while agenda:
            r, i = heapq.heappop(agenda)
            j = right[i]
            if sym[i] is None or j >= n or rank.get((sym[i], sym[j])) != r:
                continue
            sym[i], sym[j] = sym[i] + sym[j], None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(agenda, (r, i))
            h = left[i]
            if h >= 0 and (r := rank.get((sym[h], sym[i]))) is not None:
                heapq.heappush(agenda, (r, h))
        return [self.id[s] for s in sym if s is not None]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; UNRANKED where a symbol is missing (-1) or no merge joins them."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((b >= 0) & (self.keys[at] == key), self.ranks[at], UNRANKED)

    def merge_many(self, sym: np.ndarray) -> np.ndarray:
        """Rows of symbols, -1 behind each row's end, merged together: in every step each row's best pair, the leftmost among equals."""
        wide = sym.shape[1]
        sym = np.pad(sym, ((0, 0), (0, 1)), constant_values=-1)
        best = self.rank_of(sym[:, :-1], sym[:, 1:])
        columns, rows = np.arange(wide + 1), np.arange(len(sym))
        while len(rows):
            at = best[rows].argmin(1)
            r = best[rows, at]
            some = r != UNRANKED
            rows, at, r = rows[some], at[some], r[some]
            if not len(rows):
                break
            new = self.made[r]
            own = sym[rows]
            own[np.arange(len(rows)), at] = new
            own = np.take_along_axis(own, np.minimum(columns + (columns > at[:, None]), wide), 1)
            sym[rows] = own
            ranks = np.take_along_axis(best[rows], np.minimum(columns[:-1] + (columns[:-1] > at[:, None]), wide - 1), 1)
            ranks[:, -1] = UNRANKED
            every = np.arange(len(rows))
            ranks[every, at] = self.rank_of(new, own[every, at + 1])
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self.rank_of(own[inner, at[inner] - 1], new[inner])
            best[rows] = ranks
        return sym[:, :-1]

    def encode_words(self, words: list[str]) -> list[tuple[int, str, str]]:
        """(tokens, decimal ids joined by a space, token texts joined by a space) of words, one character a byte.

        The words lie one after the other; forced boundaries cut them into fragments, fragments
        of about one length are merged together, and each leaves its tokens where it began.
        """
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        place = self.place[flat]
        end = np.zeros(len(flat), bool)
        end[np.cumsum(size) - 1] = True
        sym = np.where(end, self.last[flat], self.inner[flat])
        cut = end.copy()
        cut[:-1] |= ~self.inside[place[:-1], place[1:]]
        stop = np.flatnonzero(cut) + 1
        start = np.append(0, stop[:-1])
        length = stop - start
        order = np.argsort(length, kind="stable")
        order = order[np.searchsorted(length[order], 2) :]  # one symbol is a token
        few = order[: np.searchsorted(length[order], SHORT, side="right")]
        for k in range(0, len(few), MANY):
            some = few[k : k + MANY]
            columns = np.arange(length[some[-1]])
            own = columns < length[some][:, None]
            where = start[some][:, None] + columns
            rows = np.full(own.shape, -1, np.int64)
            rows[own] = sym[where[own]]
            sym[where[own]] = self.merge_many(rows)[own]
        for k in order[len(few) :]:
            a, b = int(start[k]), int(stop[k])
            ids = self.merge("".join(map(chr, flat[a:b])) + (self.suffix if end[b - 1] else ""))
            sym[a:b] = -1
            sym[a : a + len(ids)] = ids
        real = sym >= 0
        n = np.add.reduceat(real.astype(np.int64), np.append(0, np.cumsum(size)[:-1]))
        token = pa.array(sym[real])
        offsets, gap = pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.scalar(" ", pa.large_string())
        ids, texts = (pc.binary_join(pa.ListArray.from_arrays(offsets, x.take(token)), gap).to_pylist() for x in (self.numbers, self.names))
        return list(zip(n.tolist(), ids, texts, strict=True))

    def joined_up(self, parts: list[tuple[int, str, str]]) -> tuple[int, str, str]:
        parts = [p for p in parts if p[0]]
        if len(parts) == 1:
            return parts[0]
        return sum(p[0] for p in parts), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])

    def encode_segment(self, segment: str) -> tuple[int, str, str]:
        """A stretch of text by itself; special strings in it are tokens of their own."""
        out = []
        for part in self.marks.split(segment) if self.marks else [segment]:
            if part in self.special:
                out.append((1, str(self.special[part]), part))
            elif part:
                words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                out += [self.word[w] for w, _ in words]
        return self.joined_up(out)

    def encode_segments(self, segments: list[str]) -> list[tuple[int, str, str]]:
        """Many segments; those that are new go through normalisation and split together, a space between them.

        No step reaches across a space. Where a segment brings white space of its own, or a
        special string, the segments go one by one.
        """
        memo, word = self.segment, self.word
        fresh = [x for x in segments if x not in memo and x not in memo.old]
        made: dict[str, tuple[int, str, str]] = {}
        split: dict[str, list[str]] = {}
        for k in range(0, len(fresh), TOGETHER):
            some = fresh[k : k + TOGETHER]
            shown = self.library.normalizer.normalize_str(text := " ".join(some))
            pieces = shown.split(" ")
            if len(pieces) != len(some) or (self.marks and self.marks.search(text)):
                made.update((x, self.encode_segment(x)) for x in some)
                continue
            end, at, parts = len(pieces[0]), 0, [[] for _ in some]
            for w, (start, _) in self.library.pre_tokenizer.pre_tokenize_str(shown):
                while start >= end:
                    at += 1
                    end += 1 + len(pieces[at])
                parts[at].append(w)
            split.update(zip(some, parts, strict=True))
        new = list({w: None for parts in split.values() for w in parts if w not in word and w not in word.old})
        coded = dict(zip(new, self.encode_words(new), strict=True)) if new else {}
        for x, parts in split.items():
            made[x] = self.joined_up([coded.get(w) or word[w] for w in parts]) if len(parts) != 1 else coded.get(parts[0]) or word[parts[0]]
        word.keep_all(coded)
        out = [made.get(x) or memo[x] for x in segments]
        memo.keep_all(made)
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


def _segments(start: np.ndarray, end: np.ndarray, data: np.ndarray) -> pa.DictionaryArray:
    """The byte ranges as a dictionary of texts: their bytes lie together once what is between them is left out."""
    held = T.WORD[data]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[held]))]).dictionary_encode()


class _Row:
    """Running digests of one row; parts of a row are joined by one space."""

    def __init__(self, keep: bool):
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()
        self.parts: list[tuple[str, str]] | None = [] if keep else None

    def add(self, n: int, ids: str, text: str) -> None:
        gap = b" " if self.n else b""
        self.n += n
        self.ids.update(gap + ids.encode())
        self.text.update(gap + text.encode())
        if self.parts is not None:
            self.parts.append((ids, text))


def encode_rows(vocab: WordBpe, column: pa.Array, keep: bool = False, block: int = T.BLOCK) -> list[_Row]:
    """Every row of a column of texts, block by block; only white space, which no token holds, is cut."""
    rows = [_Row(keep) for _ in range(len(column))]
    for row, start, end, data in T.runs(column, T.WORD, block):
        if not len(row):
            continue
        coded = _segments(start, end, data)
        made = vocab.encode_segments(coded.dictionary.to_pylist())
        size = np.array([m[0] for m in made], np.int64)
        at = np.asarray(coded.indices)
        some = size[at] > 0  # a segment of white space beyond ASCII has no tokens
        at, row = at[some], row[some]
        if not len(row):
            continue
        first = np.flatnonzero(np.diff(row, prepend=-1))
        offsets, gap = pa.array(np.append(first, len(row)), pa.int32()), pa.scalar(" ", pa.large_string())
        ids, texts = (pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array([m[k] for m in made], pa.large_string()).take(pa.array(at))), gap) for k in (1, 2))
        for r, n, i, t in zip(row[first].tolist(), np.add.reduceat(size[at], first).tolist(), ids.to_pylist(), texts.to_pylist(), strict=True):
            rows[r].add(n, i, t)
    return rows


def _batches(path: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            rows = encode_rows(vocab, batch.column("text"), keep)
            cols = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([r.n for r in rows], pa.int64())}
            if keep:
                cols["ids"] = pa.array([[int(i) for ids, _ in r.parts for i in ids.split(" ")] for r in rows], pa.list_(pa.int32()))
                cols["decoded"] = pa.array([" ".join(t for _, t in r.parts) for r in rows], pa.string())
            else:
                cols["ids_sha256"] = pa.array([r.ids.hexdigest() for r in rows], pa.string())
                cols["decoded_sha256"] = pa.array([r.text.hexdigest() for r in rows], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    return run


def encode(df: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Encode every whole ``text`` with a BPE of word ends, and decode the ids again.

    Texts are cut at ASCII white space, which belongs to no token; each distinct segment of a
    block goes through normalisation, the split into words, forced boundaries and merging once.
    Without a decoder in the file, decoding is the tokens' own texts joined by spaces.
    Null or empty text, or white space alone: no tokens, and the checksum of nothing. One
    output row per input row, repeated rows too; extra columns are not carried. Empty table:
    no rows. Memory: one batch of texts, a block's tokens, and ``MEMO`` segments of at most
    ``MEMO_CHARS`` characters in each of two generations; digests of huge texts are running ones.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` the ids and the
    decoded text (``decoded``) themselves in place of the checksums.
    """
    out = "ids array<int>, decoded string" if keep_ids else "ids_sha256 string, decoded_sha256 string"
    return arrow_map(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _batches(path, keep_ids), f"doc_id long, n_tokens long, {out}")
