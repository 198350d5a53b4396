"""The training-data queries: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, class_lm, language_id, licenses, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, vector_search
from tessera.llm.common import read
from tessera.llm.oracles import ORACLE_SQL  # noqa: F401
from tessera.operators.join import spread

#: Which of the public tokenizer files to use.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_file(name: str = TOKENIZER) -> bytes:
    """The file's content, read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table; a small one, whose file is one task, is dealt to all cores, as work on texts is much for their bytes."""
    return spread(read(spark, sf_dir, "documents"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), tokenizer_file())


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_documents(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_class_lm, op3_mixing, op4_ngram_join, op5_line_dedup, op6_quality_rules, op7_language_id, op8_vector_search, op9_licenses, op10_quality_classifier)}
