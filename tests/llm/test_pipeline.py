"""The pipeline's stages over the smallest tables, each against a plain version of what it decides."""

import corpus_pipeline as C
import public_tokenizers

from tessera.llm import pieces, secrets
from tessera.llm.common import saved, table
from tests.llm.test_shingles import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(C.STAGES):
        docs = saved(stage(spark, docs, SF), "test-stage")
        kept.append(docs)
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns
    all_docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    good = {r.doc_id for r in kept[0].collect()}
    wrong = sum((labels[i].quality == 1) != (i in good) for i in labels)
    assert wrong <= 0.05 * len(labels)
    one = {d for d, _, c in brute([(i, all_docs[i].text) for i in good], 5, 80, 100) if d == c}
    assert {r.doc_id for r in kept[1].collect()} == one
    items = [f" {' '.join(r.text.lower().split())} " for r in table(spark, SF, "benchmark").collect()]
    leaks = {i for i in one if any(t in f" {' '.join(all_docs[i].text.lower().split())} " for t in items)}
    clean = {r.doc_id for r in kept[2].collect()}
    assert clean == one - leaks
    safe = {r.doc_id: r for r in kept[3].collect()}
    assert set(safe) == clean
    assert not any(secrets.base_spans(r.text) for r in safe.values())
    assert all(r.n_chars == len(r.text) for r in safe.values())
    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    last = kept[4].collect()
    assert {r.doc_id: r.n_tokens for r in last} == {i: 2 + len(v.library.encode(r.text)) for i, r in safe.items()}
    assert all(r.agrees for r in last)
    assert sorted(map(tuple, C.run(spark, SF).collect())) == sorted(map(tuple, last))
