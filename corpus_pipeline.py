"""The corpus pipeline: each stage's result is written as Parquet and read again by the next.

Quality rules reject documents, one document of each group of near copies stays, documents
that hold benchmark passages go, secrets are masked, and what is left is encoded with the
piece vocabulary and decoded again. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, pieces, quality, secrets, shingles
from tessera.llm.common import saved, table
from tessera.llm.queries import tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject (probability of good quality 0.5 or more)."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")), 0.5)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, the smallest doc_id."""
    return shingles.one_of_each(docs, words=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item or paraphrase of one."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    out = secrets.redact(docs, secrets.train(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and checksums of ids and decoded text."""
    return pieces.encode(docs, tokenizer_path())


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", decontaminated),
    ("secret scans", masked),
    ("SentencePiece encoding and decoding", encoded),
]

#: Models are trained on the way: no SQL says what they decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{k}")
    return docs
