import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import pieces as P

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab the in  \n\t▁é中\x00🙂.%A"
ODD = ["", "▁", " ", "\n", " \n a", "a\n\nb", "  ", "\n\n", " a", "a ", "a \nb", "the  cat   sat", "x" * 5000, "<s>a</s>", "a." * 300]


def texts(n=400):
    rnd = random.Random(3)
    return ODD + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_agenda_and_decode_match_the_library():
    v = P.vocabulary(MODEL)
    memos = P.Memos(v)
    for t in texts():
        ids = np.frombuffer(P.encode_text(memos, t), "<u4").tolist()
        assert ids == v.library.encode(t), t
        whole = [v.bos, *ids, v.eos]
        assert P.decode_ids(v, np.array(whole)) == v.library.decode(whole), t
    assert memos.settle()


@pytest.mark.parametrize(("chunk", "overlap"), [(8, 2), (16, 4), (5, 1)])
def test_spliced_counts_are_exact(chunk, overlap):
    v = P.vocabulary(MODEL)
    for t in texts(200):
        assert P.count_tokens(v, t, chunk, overlap) == len(v.library.encode(t)), t


def test_wrong_segment_takes_the_librarys_ids(spark, monkeypatch):
    v = P.vocabulary(MODEL)
    memos = P.Memos(v)
    memos.word["cat"] = b"\0\0\0\0"
    memos.word.fresh.append("cat")
    assert not memos.settle()


def test_operators_over_odd_rows(spark):
    v = P.vocabulary(MODEL)
    rows = [(1, None, "x"), (2, "", "y"), (3, "the cat\nsat", "z"), (3, "the cat\nsat", "z"), (None, "a", None), (4, "word " * 60000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens): r for r in P.encode(df, MODEL).collect()}
    for doc_id, text, _ in rows:
        ids = [v.bos, *v.library.encode(text or ""), v.eos]
        r = got[doc_id, len(ids)]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(v.library.decode(ids).encode()).hexdigest()
        assert r.agrees
    kept = P.encode(df, MODEL, keep_ids=True).collect()
    assert len(kept) == 6 and all(r.n_tokens == len(r.ids) for r in kept)
    counts = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in P.token_counts(df, MODEL).collect())
    assert counts == sorted((d or 0, len((t or "").encode()), n := len(v.library.encode(t or "")), n > 4096) for d, t, _ in rows)
    assert P.encode(df.limit(0), MODEL).count() == 0 and P.token_counts(df.limit(0), MODEL).count() == 0
