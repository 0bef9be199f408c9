"""Word counts of documents ``<..., value string>`` in the shuffle shapes of the survey.

All shapes return ``word, n`` and agree row by row. Spark combines rows by word inside each
map task, so a hot word reaches the shuffle as one row per task whatever the shape is. Counts by
document would hardly shrink there, so they are made inside the rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairstream.functions.hashing import salt
from fairstream.functions.parsing import tokens
from fairstream.plans.storage import small_table

KEYS = ("doc_id",)
BROADCAST_ROWS = 100_000


def repeated(docs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``*keys`` of more than one row; nulls are alike."""
    return docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys)


def doc_word_count(docs: DataFrame, keys: tuple[str, ...] = KEYS, again: DataFrame | None = None) -> DataFrame:
    """``*keys, word, n``: occurrences of each word within each document.

    Words are counted inside each row, without a shuffle. Only rows that may share their keys with others
    are summed by key and word: those that ``again`` names by all or some of the keys. Without it these
    are the ``repeated`` keys of ``docs``.
    """
    again, found = small_table(repeated(docs, keys) if again is None else again, BROADCAST_ROWS)
    if not found:
        return _counted_inside(docs, keys)
    shared = again.toDF(*[f"again_{k}" for k in again.columns])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"again_{k}")) for k in again.columns])
    shared = F.broadcast(shared) if found <= BROADCAST_ROWS else shared
    alone = _counted_inside(docs.join(shared, same, "left_anti"), keys)
    parts = _counted_inside(docs.join(shared, same, "left_semi"), keys)
    return alone.unionByName(parts.groupBy(*keys, "word").agg(F.sum("n").alias("n")))


def _counted_inside(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``*keys, word, n`` of each row by itself: a word's count is the distance between starts in the sorted words."""
    words = docs.select(*keys, F.sort_array(F.split("value", " ", -1)).alias("words"))
    opens = F.transform("words", lambda w, at: F.when(~w.eqNullSafe(F.get("words", at - 1)), at))
    starts = words.select("*", F.filter(opens, lambda at: at.isNotNull()).alias("starts"))
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("words"))
    runs = F.transform(
        "starts",
        lambda at, k: F.struct(F.get("words", at).alias("word"), (end(k) - at).cast("bigint").alias("n")),
    )
    return starts.select(*keys, F.inline(runs))


def word_count(docs: DataFrame) -> DataFrame:
    """One round; the per-document count is subsumed by map-side aggregation."""
    return tokens(docs.select("value")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _sum_salted(pairs: DataFrame) -> DataFrame:
    """Two rounds over ``salt, word, n``: by salt and word, then by word."""
    first = pairs.groupBy("salt", "word").agg(F.sum("n").alias("n"))
    return first.groupBy("word").agg(F.sum("n").alias("n"))


def word_count_salted_shuffle(docs: DataFrame, parts: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Two rounds; pairs get their salt by document and word when they are grouped.

    The count within a document is part of the map-side aggregation before the first round.
    """
    return word_count_salted_map(docs, parts, keys)


def word_count_salted_map(docs: DataFrame, parts: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Two rounds; the salt is projected together with each word, before any grouping."""
    words = tokens(docs.select(*keys, "value"))
    return _sum_salted(words.select(salt(parts, *keys, "word").alias("salt"), "word", F.lit(1).alias("n")))


def word_count_partitioned(docs: DataFrame) -> DataFrame:
    """Sum within each Spark partition, then by word.

    The per-partition sum is Spark's partial aggregation: grouping by ``spark_partition_id``
    first would only add a shuffle that moves the same rows twice.
    """
    ones = tokens(docs.select("value")).select("word", F.lit(1).alias("n"))
    return ones.groupBy("word").agg(F.sum("n").alias("n"))


def doc_count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("docs"))


def distinct_words(docs: DataFrame) -> DataFrame:
    return tokens(docs.select("value")).agg(F.countDistinct("word").alias("words"))


def mean_word_length(docs: DataFrame) -> DataFrame:
    """Mean over distinct words, in code points."""
    vocabulary = tokens(docs.select("value")).distinct()
    return vocabulary.agg(F.avg(F.length("word")).alias("mean_length"))


def word_report(docs: DataFrame) -> DataFrame:
    """``docs, words, mean_length``: documents, distinct words and their mean length."""
    vocabulary = tokens(docs.select("value")).distinct()
    words = vocabulary.agg(
        F.count(F.lit(1)).alias("words"), F.avg(F.length("word")).alias("mean_length")
    )
    return words.select(doc_count(docs).scalar().alias("docs"), "words", "mean_length")
