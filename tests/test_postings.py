"""The stored index gives what a scan of the same rows gives, whatever updates led to them."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical
from tessera.operators.postings import LexicalIndex

SCHEMA = "id string, text string, repo string, title string"
WORDS = ["gateway", "timeout", "capture", "PAY-1842", "payment", "the", "the", "the", "retry", "queue", "Über", "payload"]
QUESTIONS = ["gateway timeout", "gateway OR capture the", '"payment the" OR retry', "pay* -queue", '"the pay*" the', "the NOT gateway -timeout", "nowhere", "PAY-1842 OR über", "-the", '"the the the"']


def made(seed, n, first=0):
    rnd = random.Random(seed)
    return [(f"d{k}", " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(30))), f"r{k % 3}", f"title {k}") for k in range(first, first + n)]


def scores(df):
    return {r.id: round(r.score, 9) for r in df.collect()}


def same(spark, index, want, questions=QUESTIONS):
    rows = spark.createDataFrame(want, SCHEMA)
    for q in questions:
        got, scan = scores(index.search(lexical.parse(q))), scores(lexical.matches(rows, lexical.parse(q)))
        assert got == scan, q


@pytest.fixture
def index(spark, tmp_path):
    return LexicalIndex(spark, str(tmp_path / "index"), "repo string, title string", ("repo",), buckets=4)


def test_search_is_that_of_a_scan(spark, index):
    rows = [*made(1, 60), ("none", None, "r1", None), ("blank", "", "r1", "x")]
    index.rebuild(spark.createDataFrame(rows, SCHEMA))
    same(spark, index, rows)
    scope = F.col("repo") == "r1"
    part = spark.createDataFrame(rows, SCHEMA).where(scope)
    for q in ("gateway OR the", '"the gateway"', "pay*"):
        assert scores(index.search(lexical.parse(q), scope)) == scores(lexical.matches(part, lexical.parse(q)))


def counts(rows):
    out = {}
    for _, text, *_ in rows:
        for w in set(lexical.words_of(text or "")):
            out[w] = out.get(w, 0) + 1
    return out


def test_updates_deletions_and_compaction_change_no_result(spark, index):
    state = {r[0]: r for r in made(2, 40)}
    index.rebuild(spark.createDataFrame(list(state.values()), SCHEMA))
    rnd = random.Random(5)
    for step in range(4):
        new = made(10 + step, 8, first=rnd.randrange(50))
        gone = [(k,) for k in rnd.sample(sorted(state), 4)] + [("never there",)]
        index.update(spark.createDataFrame(new, SCHEMA), spark.createDataFrame(gone, "id string"))
        for (k,) in gone:
            state.pop(k, None)
        state |= {r[0]: r for r in new}
    rows = list(state.values())
    version = index.manifests.current()
    assert len(version.says["segments"]) == 5
    same(spark, index, rows, QUESTIONS[:5])
    assert {r.term: r.df for r in index.term_counts().collect()} == counts(rows)
    assert index.totals() == (len(rows), sum(len(lexical.words_of(r[1])) for r in rows))
    need = max(1, int(0.35 * len(rows)))
    frequent = sorted(((-n, w) for w, n in counts(rows).items() if n >= need))
    assert [(r.term, r.df) for r in index.frequent_terms().collect()] == [(w, -n) for n, w in frequent]
    index.compact()
    assert len(index.manifests.current().says["segments"]) == 1
    same(spark, index, rows, QUESTIONS[:5])
    assert {r.term: r.df for r in index.term_counts().collect()} == counts(rows)
    assert scores(index.search(lexical.parse("the"), version=version)) == scores(index.search(lexical.parse("the")))  # the version before is still whole
    index.expire(1)
    same(spark, index, rows, QUESTIONS[:2])


def test_many_updates_are_put_together(spark, index, monkeypatch):
    monkeypatch.setattr("tessera.operators.postings.MOST_SEGMENTS", 2)
    rows = []
    for k in range(4):
        rows += made(k, 3, first=3 * k)
        index.update(spark.createDataFrame(rows[-3:], SCHEMA))
        assert len(index.manifests.current().says["segments"]) <= 2
    same(spark, index, rows, QUESTIONS[:3])


def test_a_search_reads_the_folders_of_its_words(spark, index):
    index.rebuild(spark.createDataFrame(made(1, 60), SCHEMA))
    hits = index.search(lexical.parse("gateway"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [(_bucket" in plan or "PartitionFilters: [_bucket" in plan or "_bucket#" in plan
    folder = spark.createDataFrame([("gateway",)], "term string").select(index._bucket("term")).first()[0]
    post = index._matching(index.manifests.current(), ["gateway"], [], None)
    assert "In(term" in post._jdf.queryExecution().executedPlan().toString() or "EqualTo(term" in post._jdf.queryExecution().executedPlan().toString()
    full = index.with_rows(hits.limit(2)).collect()
    assert all(r.title.startswith("title") and "gateway" in r.text.lower() for r in full) and 0 <= folder < 4


def test_postings_come_in_bounded_blocks_and_carry_their_own_places(spark, index):
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    rows = [(f"d{k}", "the payment of the payment", "r0", "") for k in range(2500)]
    index.rebuild(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    v = index.manifests.current()
    assert index._read_postings(v.says["segments"][0]["name"]).agg(F.max(F.size("ids"))).first()[0] <= 1000
    hits = index.search(lexical.parse('"the payment"'))
    assert hits.count() == 2500


def test_nothing_indexed(spark, index):
    assert index.search(lexical.parse("the")).count() == 0 and index.totals() == (0, 0)
    assert index.frequent_terms().count() == 0 and index.documents().count() == 0
    assert index.update(gone=spark.createDataFrame([("a",)], "id string")).number == 0
    index.rebuild(spark.createDataFrame([], SCHEMA))
    assert index.search(lexical.parse("the")).count() == 0
    index.update(spark.createDataFrame(made(1, 5), SCHEMA))
    same(spark, index, made(1, 5), ["the"])
    assert index.stop_words(frozenset({"and"})) >= {"and", "the"}
