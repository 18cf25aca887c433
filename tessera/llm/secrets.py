"""Secret scanning: fixed patterns, and a linear-chain conditional random field beside them.

Tokens are runs of ``[A-Za-z0-9+/_.-]`` and non-ASCII bytes. Each is tagged begin, inside or
outside from its shape, the words and separators beside it and features of its file; the
field is trained in numpy on texts whose pattern matches serve as labels and on texts into
which random values were planted beside other words and separators than the patterns know
(neighbouring words are left out at random, so that shape alone can carry a secret), and
decoded by Viterbi. Pattern matches always stay; the field adds spans that touch none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import arrow_map, sample

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_KEYS = (b"password", b"passwd", b"secret", b"token", b"api")
KINDS = ("assign", "access", "hex", "crf")
BEGIN, INSIDE, OUTSIDE = 0, 1, 2

_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*range(48, 58), *range(97, 103)]] = True


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, secret's start, secret's end) of the fixed patterns, in code points."""
    out = [("assign", m.start(), m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [("access", m.start(), m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end(), m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows that may hold a pattern match; no other row does."""
    may = np.zeros(len(offs) - 1, bool)
    raw = buf.tobytes()
    for i in range(len(may)):
        b = raw[offs[i] : offs[i + 1]]
        low = b.lower()
        may[i] = any(k in low for k in _KEYS) or b"AKIA" in b
    stop = np.concatenate([[-1], np.flatnonzero(~_HEX_BYTE[buf]), [len(buf)]])
    for k in np.flatnonzero(np.diff(stop) > 32):  # a run may cross rows: its rows are then looked at
        a, b = int(stop[k]) + 1, int(stop[k + 1])
        may[np.searchsorted(offs, a, side="right") - 1 : np.searchsorted(offs, b - 1, side="right")] = True
    return may


# Classes of bytes: fields of 16 bits whose sums over a token are its shape.
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.-", *range(128, 256)]] = True
_A, _B = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
_A[97:123] += np.uint64(1)  # lower
_A[65:91] += np.uint64(1 << 16)  # upper
_A[48:58] += np.uint64(1 << 32)  # digit
_A[[*b"+/_.-"]] += np.uint64(1 << 48)  # symbol
_B[128:] += np.uint64(1)  # other letters
_B[_HEX_BYTE] += np.uint64(1 << 16)
_B[[*b"aeiouAEIOU"]] += np.uint64(1 << 32)
_B[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] += np.uint64(1 << 48)
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_SEP = np.zeros(256, np.uint8)  # bits of what stands between tokens
_SEP[[*b"=:"]], _SEP[[*b"\"'`"]], _SEP[[10, 13]], _SEP[32] = 1, 2, 4, 0
_SEP[[c for c in range(33, 127) if not _TOKEN[c] and c not in b"=:\"'`"]] = 8

SIZES = np.array([2, 3, 4, 6, 8, 12, 16, 20, 32, 40, 64])
NEAR = 1024
#: Number of values of each feature, in order.
WIDTHS = (384, 7, 7, 26, 26, 8, 17, 17, NEAR + 1, NEAR + 1, 48)
DROP = (8, 9)  # the neighbouring words


@dataclass
class Tokens:
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    feats: np.ndarray  # (tokens, features)


def _file(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each row's feature of its whole file: length, and density of digits."""
    length = offs[1:] - offs[:-1]
    digits = np.concatenate([[0], np.cumsum(_CLASS[buf] == 3)])
    dense = (digits[offs[1:]] - digits[offs[:-1]]) / np.maximum(length, 1)
    return np.minimum(np.log2(length + 1).astype(np.int64), 11) * 4 + np.searchsorted([0.005, 0.02, 0.1], dense)


def tokens(buf: np.ndarray, offs: np.ndarray, file: np.ndarray | None = None) -> Tokens:
    """Tokens and their feature values over whole rows, or over parts of rows whose ``file`` feature is given."""
    n = len(buf)
    inside = _TOKEN[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    edge[[0, n]] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (edge[:-1] | ~before))
    end = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    row = np.searchsorted(offs, start, side="right") - 1
    m = len(start)
    if not m:
        return Tokens(row, start, end, np.zeros((0, len(WIDTHS)), np.int32))
    low = np.uint64(0xFFFF)

    def fields(lut: np.ndarray) -> list[np.ndarray]:
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lut[buf])])
        d = s[end] - s[start]
        out = [((d >> np.uint64(k)) & low).astype(np.int64) for k in (0, 16, 32, 48)]
        for t in np.flatnonzero(end - start > 0xFFFF):  # sums of 16 bits would run over
            for c, k in zip(out, (0, 16, 32, 48), strict=True):
                c[t] = int(((lut[buf[start[t] : end[t]]] >> np.uint64(k)) & np.uint64(1)).sum())
        return out

    lower, upper, digit, symbol = fields(_A)
    other, hexa, vowel, caps = fields(_B)
    cls = _CLASS[buf]
    turn = np.zeros(n + 1, np.int32)
    np.cumsum(cls[1:] != cls[:-1], out=turn[1:n])
    turn[n] = turn[n - 1]
    turns = turn[end - 1] - turn[start]
    size = end - start
    letters = np.maximum(lower + upper, 1)
    bucket = np.searchsorted(SIZES, size, side="right")
    mask = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (symbol > 0) + 16 * (other > 0)
    sep = np.zeros(n + 1, np.uint8)
    gaps = _SEP[buf]
    # what stands between this token and the one before, in the same row
    prev_end = np.concatenate([[0], end[:-1]])
    prev_end = np.maximum(prev_end, offs[row])
    bits = np.zeros(m, np.int64)
    for bit in (1, 2, 4, 8):
        c = np.concatenate([np.zeros(1, np.int32), np.cumsum((gaps & bit) > 0, dtype=np.int32)])
        bits += bit * ((c[start] - c[prev_end]) > 0)
    del sep
    first = np.append(True, row[1:] != row[:-1])
    last = np.append(first[1:], True)
    bits_after = np.where(last, 16, np.append(bits[1:], 0))
    # neighbours by a cheap hash of size, ends and class counts of the lower-cased word
    b = T.LOWER[buf].astype(np.int64)
    word = (b[start] * 7919 + b[end - 1] * 104729 + b[np.minimum(start + 1, end - 1)] * 1299709 + b[(start + end) // 2] * 15485863 + size * 32452843) % NEAR
    prev_word = np.where(first, NEAR, np.append(0, word[:-1]))
    next_word = np.where(last, NEAR, np.append(word[1:], 0))
    file = _file(buf, offs) if file is None else file
    feats = np.column_stack([
        bucket * 32 + mask,
        np.searchsorted([0.001, 0.1, 0.3, 0.6, 0.9, 1.0], digit / size, side="right"),
        np.searchsorted([1, 2, 4, 6, 10, 16], turns, side="right"),
        np.where(hexa == size, 2 * bucket + 2 * 0 + (digit > 0), 24 + (bucket >= 8)),
        np.where(caps == size, 2 * bucket + ((digit > 0) & (upper > 0)), 24 + (bucket >= 8)),
        np.searchsorted([0.001, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7], vowel / letters, side="right"),
        bits, bits_after, prev_word, next_word, file[row],
    ]).astype(np.int32)
    return Tokens(row, start, end, feats)


@dataclass(frozen=True)
class Field:
    """Emission weights by feature value and tag, transitions, start and end weights."""

    emit: tuple[np.ndarray, ...]
    trans: np.ndarray
    begin: np.ndarray


def _emissions(field: Field, feats: np.ndarray) -> np.ndarray:
    e = np.zeros((len(feats), 3), np.float32)
    for k, w in enumerate(field.emit):
        e += w[feats[:, k]]
    return e


def fit(feats: np.ndarray, tags: np.ndarray, steps: int = 80, rate: float = 0.15, l2: float = 1e-5, seed: int = 0, size: np.ndarray | None = None) -> Field:
    """Maximum conditional likelihood by forward-backward and Adam; segments are (rows, time, features), the first ``size`` tokens of each count."""
    rng = np.random.default_rng(seed)
    rows, time, nf = feats.shape
    w = [np.zeros((n, 3)) for n in WIDTHS]
    p = [*w, np.zeros((3, 3)), np.zeros(3)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    live = np.arange(time) < (np.full(rows, time) if size is None else size)[:, None]
    gold = np.eye(3)[tags] * live[:, :, None]
    for step in range(1, steps + 1):
        x = feats.copy()
        for k in DROP:
            x[:, :, k] = np.where(rng.random((rows, time)) < 0.4, NEAR, x[:, :, k])
        e = sum(p[k][x[:, :, k]] for k in range(nf))
        a = np.empty((time, rows, 3))
        a[0] = e[:, 0] + p[-1]
        tr = p[-2]
        for t in range(1, time):
            a[t] = np.where(live[:, t, None], e[:, t] + np.logaddexp.reduce(a[t - 1][:, :, None] + tr[None], axis=1), a[t - 1])
        z = np.logaddexp.reduce(a[-1], axis=1)
        b = np.zeros((rows, 3))
        post = np.empty((rows, time, 3))
        g_tr = np.zeros((3, 3))
        post[:, -1] = np.exp(a[-1] - z[:, None])
        for t in range(time - 2, -1, -1):
            pair = a[t][:, :, None] + tr[None] + (e[:, t + 1] + b)[:, None, :] - z[:, None, None]
            more = live[:, t + 1, None]
            pair = np.where(more[:, :, None], np.exp(pair), 0)
            g_tr += pair.sum(0)
            post[:, t] = np.where(more, pair.sum(2), np.exp(a[t] - z[:, None]))
            b = np.where(more, np.logaddexp.reduce(tr[None] + (e[:, t + 1] + b)[:, None, :], axis=2), 0)
        post *= live[:, :, None]
        d = (post - gold).reshape(-1, 3)
        flat = x.reshape(-1, nf)
        g = [np.column_stack([np.bincount(flat[:, k], d[:, c], WIDTHS[k]) for c in range(3)]) for k in range(nf)]
        seen = np.einsum("rti,rtj->ij", gold[:, :-1], gold[:, 1:])
        g += [g_tr - seen, (post[:, 0] - gold[:, 0]).sum(0)]
        for i, gi in enumerate(g):
            gi = gi / rows + l2 * p[i] * rows
            m[i] = 0.9 * m[i] + 0.1 * gi
            v[i] = 0.99 * v[i] + 0.01 * gi * gi
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)
    return Field(tuple(a.astype(np.float32) for a in p[:nf]), p[-2].astype(np.float32), p[-1].astype(np.float32))


def tag(field: Field, tok: Tokens) -> np.ndarray:
    """Viterbi tags of all tokens.

    Where outside beats both other tags by more than any two transitions can give back, every
    best path is outside; between such tokens the path is found apart, so only the few runs
    of doubtful tokens are walked (all runs at once, by their position).
    """
    out = np.full(len(tok.row), OUTSIDE, np.int8)
    if not len(out):
        return out
    e = _emissions(field, tok.feats)
    tr = field.trans
    into = np.vstack([tr, field.begin[None]])
    gain = max(float((into[a, s] - into[a, OUTSIDE]) + max(0.0, (tr[s] - tr[OUTSIDE]).max())) for a in range(4) for s in (BEGIN, INSIDE))
    doubt = np.flatnonzero(np.maximum(e[:, BEGIN], e[:, INSIDE]) + max(gain, 0.0) >= e[:, OUTSIDE])
    if not len(doubt):
        return out
    new = np.append(True, (np.diff(doubt) > 1) | (tok.row[doubt[1:]] != tok.row[doubt[:-1]]))
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(doubt)))
    first_of_row = np.append(True, tok.row[1:] != tok.row[:-1])
    last_of_row = np.append(first_of_row[1:], True)
    order = np.argsort(-size, kind="stable")
    head, size = head[order], size[order]
    at = doubt[head]
    score = e[at] + np.where(first_of_row[at][:, None], field.begin[None], tr[OUTSIDE][None])
    score = score.astype(np.float64)
    back: list[np.ndarray] = []
    final = np.empty(len(head), np.int64)

    def close(live: int, upto: int) -> None:
        """Runs ``live`` to ``upto`` end here; what follows is outside, or nothing."""
        t = at[live:upto] + size[live:upto] - 1
        final[live:upto] = (score[live:upto] + np.where(last_of_row[t][:, None], 0, tr[:, OUTSIDE][None])).argmax(1)

    live, t = len(head), 1
    while live:
        still = int(np.searchsorted(-size, -t, side="left"))  # runs longer than t
        close(still, live)
        if not still:
            break
        step = score[:still, :, None] + tr[None]
        back.append(step.argmax(1))
        score[:still] = step.max(1) + e[at[:still] + t]
        live, t = still, t + 1
    state = final
    for t in range(int(size[0]) - 1, -1, -1):
        n = int(np.searchsorted(-size, -t, side="left"))
        out[at[:n] + t] = state[:n]
        if t:
            state = state.copy()
            state[:n] = np.where(size[:n] > t, back[t - 1][np.arange(n), state[:n]], state[:n])
    return out


def _gold(tok: Tokens, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """Tags of tokens that lie in the rows' byte spans."""
    out = np.full(len(tok.row), OUTSIDE, np.int64)
    for i, some in enumerate(spans):
        a, b = np.searchsorted(tok.row, [i, i + 1])
        for s, e in some:
            k = np.flatnonzero((tok.start[a:b] >= s) & (tok.end[a:b] <= e)) + a
            if len(k):
                out[k], out[k[0]] = INSIDE, BEGIN
    return out


#: Words and separators beside planted values, none of which the patterns know.
PLANT_WORDS = ("key", "auth", "pwd", "pass", "bearer", "credential", "private", "access", "client", "login", "sig", "license", "session", "cookie", "pin", "conn")
PLANT_BETWEEN = (" ", " = ", "=", ": ", " is ", " -> ", " => ", "(", ' "', " '", ":", " := ", "\t", "\n", ", ")
PLANT_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "abcdefghijklmnopqrstuvwxyz0123456789")


def planted(text: str, rng: np.random.Generator) -> tuple[str, int, int] | None:
    """``text`` with a random value planted between two words, and where it stands; None if it would not look random."""
    alphabet = PLANT_ALPHABETS[rng.integers(len(PLANT_ALPHABETS))]
    value = "".join(alphabet[k] for k in rng.integers(0, len(alphabet), int(rng.integers(16, 49))))
    if sum(c.isdigit() for c in value) < 2 or sum(c.isalpha() for c in value) < 2:
        return None
    spaces = [m.start() for m in re.finditer(r"\s", text)] or [len(text)]
    at = spaces[rng.integers(len(spaces))]
    own = text[:at].split()
    word = PLANT_WORDS[rng.integers(len(PLANT_WORDS))] if not own or rng.random() < 0.7 else own[rng.integers(len(own))]
    head = f"{text[:at]} {word}{PLANT_BETWEEN[rng.integers(len(PLANT_BETWEEN))]}"
    return head + value + text[at:], len(head), len(head) + len(value)


def _segment_batches(segment: int, each: int, seed: int):
    """Segments of tokens (features, tags) of each text: ``each`` with secrets, as many without, and one with a planted value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, bytes, bytes]] = []
            buf, offs = T.utf8(batch.column("text"))
            may, nth = candidates(buf, offs), batch.column("nth").to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(may | (nth % 8 == 0)):
                text, rng = batch.column("text")[i].as_py() or "", np.random.default_rng([seed, int(nth[i])])
                spans = [(s, e) for _, _, _, s, e in base_spans(text)]
                versions = [(text, spans, spans)]
                if nth[i] % 8 == 0 and (more := planted(text, rng)) is not None:
                    known = [(s, e) for _, _, _, s, e in base_spans(more[0])]
                    versions.append((more[0], [*known, more[1:]], [more[1:]]))
                for v, (t, gold, wanted) in enumerate(versions):
                    ends = np.cumsum([0, *(len(c.encode()) for c in t)]) if gold else None
                    tok = tokens(*T.utf8(pa.array([t])))
                    tags = _gold(tok, [[(int(ends[s]), int(ends[e])) for s, e in gold]])
                    want = _gold(tok, [[(int(ends[s]), int(ends[e])) for s, e in wanted]]) != OUTSIDE
                    first = np.arange(0, len(tags), segment)
                    has = np.logical_or.reduceat(want, first) if len(first) else np.zeros(0, bool)
                    free = np.logical_or.reduceat(tags != OUTSIDE, first) == 0 if len(first) else has
                    odd = np.logical_or.reduceat((tok.feats[:, 1] > 0) | (tok.feats[:, 0] >= 7 * 32), first) if len(first) else has
                    picks = [(0 if not v else 1, rng.permutation(first[has])[:each])]
                    if not v:
                        long = np.where(free, np.maximum.reduceat(tok.end - tok.start, first), 0) if len(first) else has
                        picks += [(2, rng.permutation(first[free & odd])[:each]), (3, rng.permutation(first[free & ~odd])[:each]), (4, first[[long.argmax()]] if long.any() else first[:0])]
                    rows += [(k, int(nth[i]), tok.feats[a : a + segment].astype("<u2").tobytes(), tags[a : a + segment].astype("u1").tobytes()) for k, at in picks for a in at]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["kind", "nth", "feats", "tags"])

    return run


def margins(field: Field, feats: np.ndarray, tags: np.ndarray) -> float:
    """By how much the path of some tags beats the one that is outside everywhere, over one segment."""
    e = _emissions(field, feats)

    def value(path: np.ndarray) -> float:
        return float(field.begin[path[0]] + e[np.arange(len(path)), path].sum() + field.trans[path[:-1], path[1:]].sum())

    return value(tags) - value(np.full(len(tags), OUTSIDE))


def with_margin(field: Field, least: float) -> Field:
    """The field that tags a span only where its path beats the one outside by ``least``: entering a span costs as much."""
    trans, begin = field.trans.copy(), field.begin.copy()
    trans[OUTSIDE, [BEGIN, INSIDE]] -= least
    begin[[BEGIN, INSIDE]] -= least
    return Field(field.emit, trans, begin)


def train(docs: DataFrame, max_rows: int = 16000, segment: int = 32, max_segments: int = 2400, each: int = 2, seed: int = 0, keep: float = 0.99) -> Field:
    """Fit on segments of at most ``max_rows`` texts (by hashed id).

    A span must beat the path outside by a margin: the one that ``keep`` of the planted values
    reach which the field finds among training segments that it was not fitted on.

    A text gives at most ``each`` segments with matches, with digits or long words but no match, and with
    neither, and the one of its longest word without a match; one in eight gives one with a
    planted value. A quarter of ``max_segments`` each (the longest words: as many again),
    in the order of the hashed ids, is fitted on. Only features and tags reach the driver.
    Short texts and ends of texts count too. Nothing to learn from: a field that tags nothing.
    """
    chosen = sample(docs.select("doc_id"), "doc_id", max_rows).distinct()
    rows = docs.select("doc_id", F.col("text").cast("string"), F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 40)).alias("nth")).join(F.broadcast(chosen), "doc_id")
    got = arrow_map(rows.select("text", "nth"), _segment_batches(segment, each, seed), "kind int, nth long, feats binary, tags binary").collect()
    got.sort(key=lambda r: (r.nth, r.feats, r.tags))
    kinds = [[r for r in got if r.kind == k][: max_segments // 4] for k in range(5)]
    used = [r for k in kinds for r in k]
    if not kinds[0] and not kinds[1]:
        none = tuple(np.zeros((n, 3), np.float32) for n in WIDTHS)
        none[0][:, OUTSIDE] = 9  # else all tags of all tokens but the first would be equally good
        return Field(none, np.zeros((3, 3), np.float32), np.array([-9, -9, 9], np.float32))
    size = np.array([len(r.tags) for r in used])
    feats = np.stack([np.pad(np.frombuffer(r.feats, "<u2").reshape(n, -1).astype(np.int32), ((0, segment - n), (0, 0))) for r, n in zip(used, size, strict=True)])
    tags = np.stack([np.pad(np.frombuffer(r.tags, "u1").astype(np.int64), (0, segment - n)) for r, n in zip(used, size, strict=True)])
    field = fit(feats, tags, steps=200, seed=seed, size=size)
    unseen = [r for r in got if r.kind == 1][max_segments // 4 :] or kinds[1]
    told = ((np.frombuffer(r.feats, "<u2").reshape(len(r.tags), -1).astype(np.int32), np.frombuffer(r.tags, "u1").astype(np.int64)) for r in unseen)
    found = [m for x, y in told if (m := margins(field, x, y)) > 0]
    return with_margin(field, float(np.quantile(found, 1 - keep))) if found else field


def _edge(buf: np.ndarray, at: int, end: int, step: int) -> int:
    """The next place from ``at`` towards ``end`` that cuts no token."""
    while at != end and _TOKEN[buf[at]] and _TOKEN[buf[at - 1]]:
        many = min(abs(end - at), 65536)
        some = buf[at : at + many] if step > 0 else buf[at - many : at][::-1]
        gap = np.flatnonzero(~_TOKEN[some])
        at += step * (int(gap[0]) if len(gap) else many)
    return at


def _row_spans(field: Field, buf: np.ndarray, offs: np.ndarray, limit: int = T.BLOCK, side: int = 1 << 16) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) in the row's bytes of what the field tags.

    Rows go through in blocks of about ``limit`` bytes; a longer row in parts that overlap by
    ``side`` bytes on each side, of which spans that begin in the part's own bytes are taken.
    Parts cut no token and know the feature of the whole file, so a row's tags do not depend
    on where it is cut, unless doubtful tokens run on for more than ``side`` bytes.
    """
    k = 0
    while k < len(offs) - 1:
        j = max(k + 1, int(np.searchsorted(offs, offs[k] + limit, side="right")) - 1)
        a, b = int(offs[k]), int(offs[j])
        file = _file(buf[a:b], offs[k : j + 1] - a)
        if b - a <= 2 * limit:
            parts = [(a, b, a, b, offs[k : j + 1] - a)]
        else:
            parts, s = [], a
            while s < b:
                e = _edge(buf, min(b, s + limit), b, 1)
                lo, hi = _edge(buf, max(a, s - side), a, -1), _edge(buf, min(b, e + side), b, 1)
                parts.append((lo, hi, s, e, np.array([0, hi - lo])))
                s = e
        for lo, hi, s, e, own in parts:
            part = buf[lo:hi]
            tok = tokens(part, own, file)
            tags = tag(field, tok)
            hit = np.flatnonzero(tags != OUTSIDE)
            spans: list[list[int]] = []
            for i in hit:
                if tags[i] == INSIDE and spans and spans[-1][3] == i - 1 and spans[-1][0] == tok.row[i]:
                    spans[-1][2:] = [int(tok.end[i]), int(i)]
                else:
                    spans.append([int(tok.row[i]), int(tok.start[i]), int(tok.end[i]), int(i)])
            for r, x, y, _ in spans:
                if s <= x + lo < e:
                    y += lo
                    while y < int(offs[k + r + 1]) and buf[y] == 61:  # padding belongs to the secret
                        y += 1
                    yield k + r, x + lo - int(offs[k + r]), y - int(offs[k + r])
        k = j


def scan_text(text: str, added: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """All spans of a text in code points, given the field's spans in bytes."""
    base = [(k, s, e) for k, s, e, _, _ in base_spans(text)]
    raw = text.encode()
    out = list(base)
    for s, e in added:
        a = len(raw[:s].decode())
        b = a + len(raw[s:e].decode())
        if b - a >= 8 and not any(a < y and x < b for _, x, y in base):
            out.append(("crf", a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _batch_spans(field: Field, column: pa.Array) -> list[list[tuple[str, int, int]]]:
    buf, offs = T.utf8(column)
    may = candidates(buf, offs)
    added: dict[int, list[tuple[int, int]]] = {}
    for r, s, e in _row_spans(field, buf, offs):
        added.setdefault(r, []).append((s, e))
    return [scan_text(column[i].as_py() or "", added.get(i, [])) if may[i] or i in added else [] for i in range(len(column))]


def _scan_batches(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for spans in _batch_spans(field, batch.column("text")):
                base = [s for s in spans if s[0] != "crf"]
                for c, k in zip(cols, KINDS[:3], strict=False):
                    c.append(sum(s[0] == k for s in base))
                cols[3].append(hashlib.sha256(_join(base).encode()).hexdigest())
                cols[4].append(_join(spans))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """Spans of secrets in every whole text, ``kind:start:end`` in code points, end exclusive.

    Null or empty text: no spans. A very long text goes in parts of whole tokens, with the
    features of the whole. One row per input row, repeated ones too; of two spans that begin
    together the kind listed first comes first. Extra columns are not carried. Empty table: no
    rows.
    """
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _scan_batches(field), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field, mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every span of ``text`` replaced by ``mask``; null stays null."""
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), _batch_spans(field, batch.column(at)), strict=True):
                for _, s, e in reversed(_merged(spans)):
                    text = text[:s] + mask + text[e:]
                texts.append(text)
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return arrow_map(docs, run, schema)


def _merged(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for k, s, e in sorted(spans, key=lambda x: x[1]):
        if out and s < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(e, out[-1][2]))
        else:
            out.append((k, s, e))
    return out
