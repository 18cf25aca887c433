"""Merge-type piece vocabularies: agenda encoding, decoding, and resynchronised token counts.

``Vocabulary`` reads a SentencePiece BPE model file through the public library's protobuf.
``stable(a, b)`` is the fact that both operators rest on: a merge can only build a piece of
the vocabulary, so if no piece holds the characters ``a b`` side by side, no symbol ever
spans that place, and the text's encoding is the encodings of both sides put together.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

SPACE = "▁"
#: Segments of text that a worker remembers; two generations of this size at most.
MEMO = 300_000
#: Code points of a chunk of a huge document, and of the overlap tried first.
CHUNK, OVERLAP = 1 << 16, 256


class Vocabulary:
    """Pieces, scores and byte fallback of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, size = self.library, self.library.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        plain = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.id = {names[i]: i for i in plain}
        score = {names[i]: lib.get_score(i) for i in plain}
        order = {x: k for k, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: order[x] for p, x in score.items()}
        self.byte = {int(names[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.adjacent = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.text = [names[i].replace(SPACE, " ").encode() if names[i] in self.id else b"" for i in range(size)]
        for b, i in self.byte.items():
            self.text[i] = bytes([b])
        self.width = np.array([len(names[i]) for i in range(size)], np.int64)
        for b, i in self.byte.items():
            self.width[i] = 0 if 0x80 <= b < 0xC0 else 1  # code points that a token starts
        #: Lines can be encoded apart if no piece holds a line end, words if none has a space inside.
        self.lines_apart = not any("\n" in p for p in self.id) and 10 in self.byte
        self.single = {c: np.array([self.id[c]] if c in self.id else [self.byte.get(ord(c), self.unk)], "<u4").tobytes() for c in "\n.,"}
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.id)

    def stable(self, a: str, b: str) -> bool:
        return a + b not in self.adjacent

    def agenda(self, text: str) -> list[int]:
        """Ids of one segment (spaces already written as U+2581).

        An agenda of adjacent pairs that make a piece, best score first and leftmost among
        equals (one integer holds both); a popped pair is merged if it still stands there,
        and the pairs that the merge creates join the agenda.
        """
        rank, sym, n = self.rank, list(text), len(text)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        heap = [rank[p] << shift | i for i in range(n - 1) if (p := text[i : i + 2]) in rank]
        if heap:
            left, right = list(range(-1, n - 1)), list(range(1, n + 1))
            heapq.heapify(heap)
            pop, push = heapq.heappop, heapq.heappush
            while heap:
                e = pop(heap)
                i = e & mask
                a = sym[i]
                if a is None or (j := right[i]) >= n or rank.get(p := a + sym[j]) != e >> shift:
                    continue
                sym[i], sym[j] = p, None
                k = right[i] = right[j]
                if k < n:
                    left[k] = i
                    if (r := rank.get(p + sym[k])) is not None:
                        push(heap, r << shift | i)
                if (h := left[i]) >= 0 and (r := rank.get(sym[h] + p)) is not None:
                    push(heap, r << shift | h)
        out: list[int] = []
        for s in sym:
            if s is not None:
                if (i := self.id.get(s)) is not None:
                    out.append(i)
                elif self.byte:
                    out.extend(self.byte[b] for b in s.encode())
                else:
                    out.append(self.unk)
        return out

    def segments(self, text: str) -> list[str]:
        """The text as the model sees it, cut before every run of spaces (each cut is stable)."""
        if not text:
            return []
        shown = SPACE + text.replace(" ", SPACE)
        if not self.words_apart:
            return [shown]
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", shown)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Memo(dict):
    """Segment -> ids as little-endian bytes. ``lead`` is put before a segment to encode it.

    Two generations: the older goes when the newer is full, so memory is bounded.
    """

    def __init__(self, vocab: Vocabulary, lead: str = ""):
        self.vocab, self.lead, self.old, self.fresh = vocab, lead, {}, []

    def __missing__(self, seg: str) -> bytes:
        out = self.old.get(seg)
        if out is None:
            v = self.vocab
            if len(seg) > 1 and seg[-1] in ".," and v.stable(seg[-2], seg[-1]):
                out = self[seg[:-1]] + v.single[seg[-1]]
            else:
                out = np.array(v.agenda(self.lead + seg), "<u4").tobytes()
            self.fresh.append(seg)
        self[seg] = out
        return out

    def trim(self) -> None:
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()

    def agree(self) -> bool:
        """Whether the library encodes all segments that are new since the last call alike.

        The library puts a space before what it is given. A segment that has none gets a line
        end in front, which no piece joins to it, so that the rest are its own ids.
        """
        segs, self.fresh = [s for s in self.fresh if s], []
        given, skip = segs, 0
        if not self.lead:
            given, skip = ["\n" + s.replace(SPACE, " ") for s in segs], 4 * len(self.vocab.library.encode("\n"))
        ids = self.vocab.library.encode(given, num_threads=1)
        return all(np.array(x, "<u4").tobytes()[skip:] == (self.get(s) or self.old.get(s, b"")) for s, x in zip(segs, ids, strict=True))


class Memos:
    """What a worker remembers: words after a space, and segments as they stand."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.word, self.bare = vocab, _Memo(vocab, SPACE), _Memo(vocab)

    def full(self) -> bool:
        return len(self.word) > MEMO or len(self.bare) > MEMO

    def settle(self) -> bool:
        good = self.word.agree() & self.bare.agree()
        self.word.trim()
        self.bare.trim()
        return good


def encode_text(memos: Memos, text: str) -> bytes:
    """Ids of a whole text as little-endian bytes."""
    v = memos.vocab
    if not text:
        return b""
    if not (v.lines_apart and v.words_apart) or SPACE in text or "  " in text or " \n" in text or text[0] == " " or text[-1] == " ":
        if not v.words_apart:
            return np.array(v.agenda(SPACE + text.replace(" ", SPACE)), "<u4").tobytes()
        return b"".join(map(memos.bare.__getitem__, v.segments(text)))
    word, parts = memos.word, []
    for k, line in enumerate(text.split("\n")):
        words = line.split(" ")
        if k:  # only the text's first line gets a space in front
            parts.append(v.single["\n"])
            if words[0]:
                parts.append(memos.bare[words[0]])
            del words[0]
        parts += map(word.__getitem__, words)
    return b"".join(parts)


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> str:
    """Text of ids: pieces put together, bytes read as UTF-8, the added first space taken off."""
    raw = b"".join(map(vocab.text.__getitem__, ids.tolist()))
    try:
        out = raw.decode()
    except UnicodeDecodeError:
        return vocab.library.decode(ids.tolist())
    return out[1:] if out[:1] == " " else out


def _encode_batches(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        memos = Memos(vocab)
        begin, end = (np.array([i], "<u4").tobytes() for i in (vocab.bos, vocab.eos))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows, agrees, since = [], [], 0
            for k, text in enumerate(texts):
                ids = begin + encode_text(memos, text) + end
                rows.append(_row(vocab, ids, with_ids))
                if memos.full() or k == len(texts) - 1:
                    good = memos.settle()
                    for at in range(since, len(rows)):  # a wrong segment: the library's ids for what may hold it
                        same = True
                        if not good:
                            ids = np.array([vocab.bos, *vocab.library.encode(texts[at]), vocab.eos], "<u4").tobytes()
                            row = _row(vocab, ids, with_ids)
                            same, rows[at] = row == rows[at], row
                        agrees.append(same)
                    since = len(rows)
            n, sha, out, every = zip(*rows, strict=True) if rows else ((),) * 4
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(out, pa.string()), pa.array(agrees, pa.bool_())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded" if with_ids else "decoded_sha256", "agrees"]
            if with_ids:
                cols.append(pa.array(every, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _row(vocab: Vocabulary, ids: bytes, with_ids: bool) -> tuple:
    a = np.frombuffer(ids, "<u4")
    text = decode_ids(vocab, a)
    return len(a), hashlib.sha256(ids).hexdigest(), text if with_ids else hashlib.sha256(text.encode()).hexdigest(), a.tolist() if with_ids else None


def encode(df: DataFrame, model: str, keep_ids: bool = False) -> DataFrame:
    """Encode ``text`` with begin and end ids, and decode the ids again.

    Segments between proven stable places are encoded once per worker by the score-ordered
    agenda; every Arrow batch's new segments are checked against the sentencepiece library.
    If one differs, the library's ids are taken for the texts that may hold it, and
    ``agrees`` is false where they differ from the agenda's.
    Null or empty text: begin and end only. Repeated rows and extra columns: one output row
    per input row, extra columns are not carried. Empty table: no rows.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, agrees; with ``keep_ids`` the ids
    and the decoded text (``decoded``) themselves.
    """
    text = "decoded string, agrees boolean, ids array<int>" if keep_ids else "decoded_sha256 string, agrees boolean"
    return arrow_map(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _encode_batches(model, keep_ids), f"doc_id long, n_tokens long, ids_sha256 string, {text}")


def _offsets(vocab: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Code point at which each token starts in the chunk; the added first space counts as -1."""
    starts = np.cumsum(vocab.width[ids]) - vocab.width[ids]
    return starts - 1


def count_tokens(vocab: Vocabulary, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a whole text, huge texts by overlapping chunks.

    Neighbouring chunks are spliced at the first place in their overlap where both have a
    token boundary and the characters beside it prove it stable. If there is none, the left
    chunk is lengthened, twice as far each time, at last to the end of the text.
    """
    lib = vocab.library
    if len(text) <= chunk + overlap:
        return len(lib.encode(text))
    total, begin = 0, 0  # begin: start of the chunk on the left, from splice point ``done`` on
    done, end = 0, min(len(text), chunk)
    wide = overlap
    ids = np.asarray(lib.encode(text[begin:end]), np.int64)
    while True:
        at = _offsets(vocab, ids) + begin
        if end == len(text):
            return total + int((at >= done).sum()) if done else total + len(ids)
        nxt = max(done + 1, end - wide)
        new_end = min(len(text), nxt + chunk)
        new = np.asarray(lib.encode(text[nxt:new_end]), np.int64)
        new_at = _offsets(vocab, new) + nxt
        both = np.intersect1d(at, new_at)
        both = both[(both > nxt) & (both < end)]
        q = next((int(b) for b in both if vocab.stable(_shown(text[b - 1]), _shown(text[b]))), None)
        if q is None:
            wide *= 2
            end = min(len(text), end + wide)
            ids = np.asarray(lib.encode(text[begin:end]), np.int64)
            continue
        total += int(((at >= done) & (at < q)).sum()) if done else int((at < q).sum())
        done, begin, end, ids, wide = q, nxt, new_end, new, overlap


def _shown(c: str) -> str:
    return SPACE if c == " " else c


def _count_batches(path: str, limit: int, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = [0] * len(texts)
            short = [k for k, t in enumerate(texts) if len(t) <= chunk + overlap]
            for a in range(0, len(short), 64):
                some = short[a : a + 64]
                for k, ids in zip(some, vocab.library.encode([texts[k] for k in some], num_threads=1), strict=True):
                    n[k] = len(ids)
            for k in set(range(len(texts))) - set(short):
                n[k] = count_tokens(vocab, texts[k], chunk, overlap)
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(df: DataFrame, model: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Tokens of every whole ``text``, without begin, end or added tokens.

    Null or empty text: 0 bytes, 0 tokens. One output row per input row, repeated rows too;
    extra columns are not carried. Empty table: no rows. Memory: one batch of texts and one
    chunk's ids; a huge document costs chunks, not one long encoding.
    """
    return arrow_map(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _count_batches(model, limit, chunk, overlap), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
