"""The corpus pipeline: four stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fairstream.llm import langid, mixing, pieces, simhash
from fairstream.llm.queries import small_batches, tokenizer_file
from fairstream.plans.storage import stored


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; what has no letters, or no likely language, goes.

    Null and empty texts go. Texts are judged whole, repeated rows alike; without any labelled row all
    texts with letters stay. An empty table stays empty, columns of any names stay as they are.
    """
    small_batches(spark)
    return langid.drop_undetermined(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, null last.

    Unequal texts under one id are judged apart, repeated rows leave one row, null and wordless texts
    are copies of each other. An empty table stays empty, columns of any names stay as they are.
    """
    small_batches(spark)
    return simhash.drop_near_copies(docs)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources in training order; a document of two epochs is two rows.

    A null source is a source, a null text has no words; rows without an id are dealt by their texts.
    An empty table stays empty, columns of any names stay as they are.
    """
    return mixing.mixed(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each whole text: ``doc_id, ids, n_pieces, round_trip``.

    A null or empty text has no pieces; repeated rows give repeated rows, an empty table none.
    """
    small_batches(spark)
    return pieces.encoded(docs, tokenizer_file())


STAGES = [
    ("language_id", with_language),
    ("simhash_near_dedup", without_near_copies),
    ("mix_sources", to_target_weights),
    ("sentencepiece", as_pieces),
]

#: SQL has neither the language model nor the hash and the segmentation; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
