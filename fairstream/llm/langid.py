"""Language identification, words first.

A known word scores by its log frequency in each language. An unseen word backs off to its
character n-grams: the longest order of which the model knows any n-gram decides, and its known
n-grams score on average. The model is a table of bounded size, fitted by Spark.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairstream.plans.storage import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LETTERS = regex.compile(r"\p{L}+")
ORDERS = (4, 3, 2, 1)
CACHED_WORDS = 60_000
CHUNK = 1 << 15
BROADCAST_ROWS = 100_000
DENSE_CELLS = 1_000_000


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def grams_of(word: str, order: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents by a checksum of the id; a null id is not held out."""
    key = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % 4 == 2


@dataclass(frozen=True)
class Model:
    """Log frequencies of words and n-grams by language.

    ``words[w]`` or ``grams[g]`` is a row of a sparse table ``(floor, starts, columns, values)``: the
    languages it is known in and its log frequency there; ``floor`` is that of an unknown one.
    """

    languages: tuple[str, ...]
    words: dict[str, int]
    word_table: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    grams: dict[str, int]
    gram_table: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def row_of(table: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], row: int) -> np.ndarray:
    floor, starts, columns, values = table
    found = floor.copy()
    own = slice(starts[row], starts[row + 1])
    found[columns[own]] = values[own]
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts.update((lang, w) for w in words_of(text.as_py()))
        grams: Counter = Counter()
        for (lang, word), n in counts.items():
            for order in ORDERS:
                for gram in grams_of(word, order):
                    grams[lang, gram] += n
        for is_word, table in ((True, counts), (False, grams)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in table], pa.string()),
                    pa.array([is_word] * len(table), pa.bool_()),
                    pa.array([k[1] for k in table], pa.string()),
                    pa.array(list(table.values()), pa.int64()),
                ],
                ["lang", "is_word", "gram", "n"],
            )


def _sampled(labelled: DataFrame, max_rows: int) -> DataFrame:
    """About ``max_rows`` labelled rows, as many of each language (all of one that has fewer), by a hash."""
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL")
    sizes = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))  # reads no text
    languages = sizes.count()
    share = F.least(F.lit(1.0), F.lit(max_rows / max(1, languages)) / F.col("rows"))
    shares = sizes.select("lang", (share * float(1 << 40)).alias("below"))
    shares = F.broadcast(shares) if languages <= BROADCAST_ROWS else shares
    taken = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.col("below")
    return rows.filter("text IS NOT NULL").join(shares, "lang").filter(taken).select("lang", "text")


def fit(labelled: DataFrame, max_rows: int = 4_000, max_entries: int = 12_500) -> Model:
    """A model from ``doc_id, text, lang``; rows without text or lang teach nothing.

    ``max_rows`` bounds the expected size of the sample it learns from, dealt evenly over the
    languages, so that a rare one is learnt too. ``max_entries`` bounds the words and, apart, the
    n-grams kept of each language: its most frequent, the first by code point of equally frequent
    ones. Without labelled rows the model knows no language.
    """
    counted = _sampled(labelled, max_rows).mapInArrow(_count, "lang string, is_word boolean, gram string, n bigint")
    counts = cut(counted.groupBy("lang", "is_word", "gram").agg(F.sum("n").alias("n")))
    totals = {(r.lang, r.is_word): r.n for r in counts.groupBy("lang", "is_word").agg(F.sum("n").alias("n")).toLocalIterator()}
    languages = tuple(sorted({lang for lang, _ in totals}))
    at = {lang: i for i, lang in enumerate(languages)}
    in_order = Window.partitionBy("lang", "is_word").orderBy(F.col("n").desc(), "gram")
    top = cut(counts.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= max_entries))
    tables: list = []
    for is_word in (True, False):
        floor = np.array([math.log(0.5 / totals.get((lang, is_word), 1)) for lang in languages])
        place: dict[str, int] = {}
        columns, values, starts = [], [], [0]
        for r in top.filter(F.col("is_word") == is_word).select("gram", "lang", "n").orderBy("gram", "lang").toLocalIterator():
            if r.gram not in place:
                place[r.gram] = len(place)
                starts.append(starts[-1])
            starts[-1] += 1
            columns.append(at[r.lang])
            values.append(math.log(r.n / totals[r.lang, is_word]))
        tables += [place, (floor, np.array(starts, np.int64), np.array(columns, np.int32), np.array(values))]
    return Model(languages, *tables)


def all_rows(table: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray | None:
    """The whole table as a matrix, if it is small."""
    floor, starts, columns, values = table
    if (len(starts) - 1) * len(floor) > DENSE_CELLS:
        return None
    matrix = np.tile(floor, (len(starts) - 1, 1))
    matrix[np.repeat(np.arange(len(starts) - 1), np.diff(starts)), columns] = values
    return matrix


class _Rows(dict):
    """Word -> row of a score matrix, filled as words come up and emptied when it is full."""

    def __init__(self, model: Model):
        super().__init__()
        self.word_rows, self.gram_rows = all_rows(model.word_table), all_rows(model.gram_table)
        self.model, self.matrix = model, np.zeros((CACHED_WORDS + CHUNK, len(model.languages)))

    def vector(self, word: str) -> np.ndarray | float:
        known = self.model.words.get(word)
        if known is not None:
            return row_of(self.model.word_table, known) if self.word_rows is None else self.word_rows[known]
        get = self.model.grams.get
        for order in ORDERS:
            found = [v for g in grams_of(word, order) if (v := get(g)) is not None]
            if found:
                if self.gram_rows is None:
                    return np.mean([row_of(self.model.gram_table, v) for v in found], axis=0)
                return self.gram_rows[found].mean(0)
        return 0.0

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.matrix[at] = self.vector(word)
        return at

    def total(self, words: list[str]) -> np.ndarray:
        total = np.zeros(self.matrix.shape[1])
        for start in range(0, len(words), CHUNK):
            part = words[start : start + CHUNK]
            if len(self) > CACHED_WORDS:
                self.clear()
            total += self.matrix[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(0)
        return total


def predict(text: str | None, rows: _Rows) -> tuple[str, float]:
    words = words_of(text)
    languages = rows.model.languages
    if not words or not languages:
        return "und", 0.0
    total = rows.total(words)
    odds = np.exp(total - total.max())
    best = int(odds.argmax())
    return languages[best], float(odds[best] / odds.sum())


def language(model: Model, spark) -> callable:
    """A column function: text -> ``struct<lang_pred string, score double>``.

    ``score`` is the posterior of the language under equal priors. ``und`` with score 0 for a
    null text, a text without letters, or a model without languages; of languages with equal
    scores the first by name. The whole text is read. Nothing but the text is an input.
    """
    # plain containers: executors need no copy of this package to read them
    shared = spark.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(model)))

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows = _Rows(Model(*shared.value))
        for texts in batches:
            found = [predict(t.as_py(), rows) for t in texts]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.StructArray.from_arrays(columns, ["lang_pred", "score"])

    scores.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scores, "lang_pred string, score double")


def learnt_from(docs: DataFrame) -> Model:
    """The model of the documents that are not held out."""
    return fit(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, text, lang`` -> ``doc_id, held_out, lang_pred, score``, one row per row.

    Null and empty texts and those without a letter are ``und`` with score 0, as are all where no
    row is labelled; of languages with equal scores the first by name. A null id is not held
    out. Texts are read whole, however long; repeated rows get equal answers, an empty table gives
    an empty result, and other columns are not read.
    """
    found = language(learnt_from(docs), docs.sparkSession)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found("text").alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")


def drop_undetermined(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or scores below ``least_score``.

    A model without any language rejects only texts without letters.
    """
    model = learnt_from(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language(model, docs.sparkSession)
    name = "found_" + "_".join(docs.columns)
    judged = docs.withColumn(name, found("text"))
    return judged.filter(F.col(name)["score"] >= least_score).drop(name)
