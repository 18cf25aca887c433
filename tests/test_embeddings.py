"""Content-addressed vectors: what the embedder is asked, and what becomes of texts that it refuses."""

import pathlib

from tessera.operators.embeddings import EmbeddingCache

SCHEMA = "id long, text string"


def recording(folder, broken=()):
    """An embedder that writes down every batch it gets; texts in ``broken`` make it fail."""
    folder = str(folder)

    def fn(texts):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(texts))
        if any(t in broken for t in texts):
            raise ValueError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    return fn


def asked(folder):
    return sorted(t for f in pathlib.Path(folder).iterdir() for t in f.read_text().split("\n"))


def test_unchanged_texts_are_not_sent_again(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    cache = EmbeddingCache(spark, str(tmp_path / "v"), recording(log), 2, 4)
    rows = [(1, "alpha"), (2, "be"), (3, "alpha"), (4, None), (5, "")]
    got = cache.embed(spark.createDataFrame(rows, SCHEMA), "text").collect()
    assert {r.id: list(r.vector) for r in got} == {1: [5.0, 1.0], 2: [2.0, 1.0], 3: [5.0, 1.0], 4: [0.0, 1.0], 5: [0.0, 1.0]}
    assert asked(log) == ["", "alpha", "be"]
    again = cache.embed(spark.createDataFrame([*rows, (6, "new one")], SCHEMA), "text")
    assert {r.id: list(r.vector) for r in again.collect()}[6] == [7.0, 1.0]
    assert asked(log) == ["", "alpha", "be", "new one"]
    elsewhere = EmbeddingCache(spark, str(tmp_path / "v"), recording(log), 2, 4)  # as after a restart
    assert elsewhere.embed(spark.createDataFrame(rows, SCHEMA), "text").where("vector is null").count() == 0
    assert len(asked(log)) == 4


def test_a_refused_text_costs_itself_only_and_is_tried_again(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = spark.createDataFrame([(k, f"text {k}") for k in range(10)], SCHEMA).coalesce(1)
    got = EmbeddingCache(spark, str(tmp_path / "v"), recording(log, ("text 3",)), 2, 4).embed(rows, "text").collect()
    assert [(r.id, r.error) for r in got if r.vector is None] == [(3, "refused")] and sum(r.error is None for r in got) == 9
    better = EmbeddingCache(spark, str(tmp_path / "v"), recording(log), 2, 4).embed(rows, "text").collect()
    assert all(r.vector is not None and r.error is None for r in better)
    assert asked(log).count("text 3") == 3 and asked(log).count("text 4") == 2  # in the batch, alone, and next time


def test_wrong_shapes_and_empty_tables(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "v"), lambda texts: [[1.0]] * len(texts), 2, 4)
    got = cache.embed(spark.createDataFrame([(1, "a")], SCHEMA), "text").first()
    assert got.vector is None and "size" in got.error
    assert cache.embed(spark.createDataFrame([], SCHEMA), "text").count() == 0 and cache.table.read().count() == 0


def test_forgetting(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "v"), lambda texts: [[1.0, 2.0]] * len(texts), 2, 4)
    got = cache.embed(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), "text")
    cache.forget(got.where("id = 2"))
    assert cache.table.read().count() == 1
