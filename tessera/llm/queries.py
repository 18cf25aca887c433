"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import table

TOKENIZER, WORD_TOKENIZER = "piece_bpe_32k.model", "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import language_model_scores

    return language_model_scores(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op5_language_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .caps import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shingles import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=4096)


def op11_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wordbpe import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, percent=25, least_words=20, seed=7)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"), least_docs=30, top=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_nnpu": op1_toxicity_nnpu,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_crf": op4_secret_crf,
    "op5_language_bigru": op5_language_bigru,
    "op6_latent_decontamination": op6_latent_decontamination,
    "op7_sentencepiece_codec": op7_sentencepiece_codec,
    "op8_spherical_caps": op8_spherical_caps,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_token_counts": op10_token_counts,
    "op11_forced_boundary_bpe": op11_forced_boundary_bpe,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op8_spherical_caps": oracles.SPHERICAL_CAPS,
    "op9_ngram_jaccard": oracles.jaccard(),
    "op12_importance_resampling": oracles.importance(),
    "op13_source_divergence": oracles.divergence(),
}
