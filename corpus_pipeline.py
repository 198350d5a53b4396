"""From raw documents to token ids: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents. A stage begins with a collection of the
executors' garbage, which the one before has left.

1. The quality classifier, fitted to labels, rejects documents.
2. Lines that an earlier document holds go.
3. One document of each group of near duplicates stays.
4. Documents are taken, repeated or left out so that sources meet their shares.
5. What is left becomes token ids, which are decoded again for a check sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, line_dedup, mixing, ngram_join, quality_classifier
from tessera.llm.common import collect_garbage, discard, materialize, read, written
from tessera.llm.queries import tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collect_garbage(spark)
    return quality_classifier.good_documents(docs, read(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collect_garbage(spark)
    return line_dedup.cleaned_documents(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collect_garbage(spark)
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collect_garbage(spark)
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    collect_garbage(spark)
    return bpe.encode_documents(docs, tokenizer_file())


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_duplicates),
    ("mixing sources", mixed),
    ("BPE encoding", encoded),
]

#: The classifier's scores and the tokens are beyond SQL: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents. Once a stage's rows are written, the tables that it made on its way are deleted, and the stage's before."""
    docs, first = read(spark, sf_dir, "documents"), written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name.replace(' ', '-')}")
            discard(spark, first, written() - 1)
    return docs
