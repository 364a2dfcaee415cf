"""A corpus made ready for training: toxic documents out, one of each near copy, secrets marked, sources mixed, texts encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe, jaccard, mixing, secrets, toxicity
from tidewater.llm.common import written
from tidewater.llm.queries import vocabulary

#: Weights of sources in ascending order, repeating, and the words of the mix as a share of all words.
PATTERN, SHARE = [3, 1, 2], 1.5


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't hold toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: five-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard.keep_one(docs, k=5, percent=80)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secrets.redact_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes up to twice, and a document that the mix cuts has its first words only."""
    return mixing.mixed_documents(docs, PATTERN, SHARE)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each mixed document's token ids, and the digests of ids and decoded text."""
    return bpe.encode_documents(docs, vocabulary("byte_bpe_50k.json"), keep=["doc_id", "lang", "source"], with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_copies),
    ("secrets", secret_spans),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: No SQL can express the classifier or the merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
