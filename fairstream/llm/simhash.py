"""SimHash near-duplicates by bit-sliced comparison.

A pair of fingerprints that differ in at most two of 64 bits agrees on at least two of four
16-bit quarters. Each distinct fingerprint therefore goes under six keys of 32 agreed bits, and
only fingerprints under one key are compared. A key with too many fingerprints is exchanged for
three finer ones: its undecided bits are dealt into three groups, of which a close pair agrees
on one. After four such steps few bits are undecided, so a group is bounded whatever the data.

Inside a task the groups are compared bit-sliced: word ``w`` of plane ``i`` holds bit ``i`` of 64
fingerprints, and carry-save counters update 64 distances with a few bitwise operations.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairstream.llm import jaccard
from fairstream.llm.graph import components, forest
from fairstream.plans.storage import cut, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RADIUS = 2
SHINGLE = 3
GROUP_LIMIT = 2048
CHUNK = 1 << 16
BROADCAST_ROWS = 100_000
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PLANES_A_STEP = 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the hashes of all word shingles; zero for a text without words."""
    # bytes.split() splits at just the six ASCII blanks of the word definition
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, count, CHUNK):
        part = (
            xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42)
            for i in range(start, min(start + CHUNK, count))
        )
        hashes = np.fromiter(part, np.dtype("<u8"), min(CHUNK, count - start))
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, fp bigint`` (the 64 bits as a signed number), one row per row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _first_masks() -> list[int]:
    quarters = [0xFFFF << (16 * i) for i in range(4)]
    return [a | b for a, b in itertools.combinations(quarters, 2)]


def _finer(mask: int) -> list[int]:
    open_bits = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in open_bits[j::3]) for j in range(3)]


def keyed(prints: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """``fp`` -> ``mask, bits, fp``: every close pair shares a ``(mask, bits)``, no group is large."""
    masks = _first_masks()
    keys = prints.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    keys = keys.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
    for _ in range(4):
        hot = cut(keys.groupBy("mask", "bits").count().filter(F.col("count") > limit).select("mask", "bits", F.lit(True).alias("hot")))
        rows = hot.count()
        if not rows:
            break
        small = F.broadcast(hot) if rows <= BROADCAST_ROWS else hot
        marked = keys.join(small, ["mask", "bits"], "left")
        children = F.create_map(
            *itertools.chain.from_iterable(
                (F.lit(_signed(m)), F.array(*(F.lit(_signed(c)) for c in _finer(m)))) for m in masks
            )
        )
        step = F.when(F.col("hot"), children[F.col("mask")]).otherwise(F.array("mask"))
        keys = marked.select("fp", F.explode(step).alias("mask"))
        keys = stored(keys.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask"))), "simhash-keys")
        masks = sorted({c for m in masks for c in _finer(m)})
    return keys


def close_pairs(values: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of one group that differ in at most ``radius`` (0 to 2) bits.

    ``group`` is ascending. Groups start at a new word, so a word never mixes groups.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    words = (sizes + 63) // 64
    first_word = np.r_[0, np.cumsum(words)[:-1]]
    of = np.repeat(np.arange(len(starts)), sizes)
    inside = np.arange(len(group)) - starts[of]
    word, lane = first_word[of] + inside // 64, (inside % 64).astype(np.uint64)
    planes = np.zeros((64, int(words.sum())), np.uint64)
    for i in range(64):
        np.bitwise_or.at(planes[i], word, ((values >> np.uint64(i)) & np.uint64(1)) << lane)
    # each fingerprint against its own word and those after it
    spans = words[of] - inside // 64
    query = np.repeat(np.arange(len(group)), spans)
    target = np.repeat(word, spans) + np.arange(len(query)) - np.repeat(np.cumsum(spans) - spans, spans)
    last = first_word[of] + words[of] - 1
    filled = np.where(target == last[query], (sizes[of] - 1)[query] % 64 + 1, 64).astype(np.uint64)
    far = np.where(filled == 64, np.uint64(0), ALL << (filled % np.uint64(64)))
    same = target == word[query]  # in the own word only lanes after the own one
    mine = lane[query[same]]
    far[same] |= (np.uint64(1) << mine) | ((np.uint64(1) << mine) - np.uint64(1))
    ones, twos = np.zeros(len(query), np.uint64), np.zeros(len(query), np.uint64)
    for low in range(0, 64, PLANES_A_STEP):
        for i in range(low, low + PLANES_A_STEP):
            bit = (values[query] >> np.uint64(i)) & np.uint64(1)
            differ = planes[i][target] ^ (np.uint64(0) - bit)
            carry = ones & differ
            ones ^= differ
            far |= twos & carry
            twos ^= carry
            # beyond the radius once and for all: a count that wraps later stays out
            far |= twos & ones if radius == 2 else (twos if radius == 1 else twos | ones)
        alive = np.flatnonzero(far != ALL)  # abandon the blocks in which all exceed the radius
        if len(alive) < len(query):
            query, target, far, ones, twos = query[alive], target[alive], far[alive], ones[alive], twos[alive]
    near = np.unpackbits((~far).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    at, lanes = np.nonzero(near)
    to = (target[at] - first_word[of[query[at]]]) * 64 + lanes + starts[of[query[at]]]
    return query[at], to


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``mask, bits, fp`` -> links ``a, b`` that connect every group's close pairs."""

    def compare(mask: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])]
        group = np.cumsum(new)
        count = np.bincount(group)[group]
        fp, group = fp[count > 1], group[count > 1]
        if not len(fp):
            a = b = fp
        else:
            one, other = close_pairs(fp.view(np.uint64), group)
            kept = forest(one, other, len(fp))
            a, b = fp[one[kept]], fp[other[kept]]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        new = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows = np.concatenate([*held, new], axis=1)
        while rows.shape[1] > CHUNK:
            # the last group may go on in the next rows; no group is longer than a chunk
            part = rows[:, :CHUNK]
            changed = np.flatnonzero((part[0, 1:] != part[0, :-1]) | (part[1, 1:] != part[1, :-1]))
            end = int(changed[-1]) + 1
            yield compare(*part[:, :end])
            rows = rows[:, end:]
        held = [rows]
    if held and held[0].shape[1]:
        yield compare(*held[0])


def near_links(prints: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Distinct ``fp`` -> ``a, b``: links whose components are those of all close pairs."""
    keys = keyed(prints, limit).select("mask", "bits", "fp")
    grouped = keys.repartition("mask", "bits").sortWithinPartitions("mask", "bits")
    return grouped.mapInArrow(_links, "a bigint, b bigint")


def simhash_components(docs: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, fp, component_id``, one row per row.

    Documents are linked if their fingerprints differ in at most two bits; ``component_id`` is
    the smallest ``doc_id`` reachable. Null and wordless texts have fingerprint zero and are linked
    like any other. A null ``doc_id`` counts for no smallest id; a component of nothing else has
    a null ``component_id``. Repeated rows and repeated ids keep their rows. Equal fingerprints
    are one class from the start, so a huge group of copies is compared once. An empty table
    gives an empty result; other columns of the input are not read.
    """
    prints = stored(fingerprints(docs), "simhash-prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    roots = components(near_links(classes.select("fp"), limit))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = cut(rooted.select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    lowest = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = cut(rooted.join(lowest, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, similarity: float = jaccard.SIMILARITY, block_rows: int = jaccard.BLOCK_ROWS) -> DataFrame:
    """One row of ``docs`` of each component of near copies; columns stay.

    Near copies have a Jaccard similarity of ``similarity`` or more over five-word shingles (the
    two bits of ``simhash_components`` reach few of them); a pair is found unless it shares none of
    28 MinHash keys, at 0.8 with probability 4e-7. The row kept is that of the smallest ``doc_id``
    (null last), then of the smallest hashes of its text and of the whole row. So unequal texts
    under one id are each judged alone, repeated rows leave one row, and reruns agree. All texts
    that are null, empty or without words are copies of each other. Equal texts are told by 128
    bits. Long texts are compared whole; an empty table gives an empty result.
    """
    first, second = jaccard.text_keys(F.col("text"))
    name = "_".join(["found", *docs.columns])  # no column of the table has this name
    keyed = docs.withColumn(name, F.struct(first.alias("first"), second.alias("second"), F.xxhash64(*(F.col(c) for c in docs.columns)).alias("row")))
    id_, found = F.col("doc_id").cast("bigint"), F.col(name)
    held = stored(keyed.select(id_.alias("doc_id"), found["first"].alias("first"), found["second"].alias("second"), found["row"].alias("row")), "near-rows")
    # texts that share their first hash but not the second get a hash of both
    shared = cut(held.groupBy("first").agg((F.min("second") != F.max("second")).alias("twice")).filter("twice"))
    twice = shared.count()
    small = F.broadcast(shared) if twice <= BROADCAST_ROWS else shared

    def told(rows: DataFrame) -> DataFrame:
        """``first, second`` -> ``fp``."""
        if not twice:
            return rows.withColumnRenamed("first", "fp").drop("second")
        fp = F.when(F.col("twice"), F.xxhash64("second", "first")).otherwise(F.col("first"))
        return rows.join(small, "first", "left").withColumn("fp", fp).drop("first", "second", "twice")

    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "row")).alias("least")
    classes = stored(told(held).groupBy("fp").agg(least), "near-classes")
    one_each = classes.select("fp", F.col("least.row").alias("row"))
    texts = told(keyed.select(found["first"].alias("first"), found["second"].alias("second"), found["row"].alias("row"), "text"))
    texts = texts.filter("fp <> 0").select("fp", "row", "text")
    roots = jaccard.near_components(classes, texts, similarity, block_rows, one_each)
    kept = stored(roots.groupBy("root").agg(F.min("least").alias("least")).select("least.fp", "least.row"), "near-kept")
    marked = told(keyed.select(found["first"].alias("first"), found["second"].alias("second"), found["row"].alias("row"), F.struct(*docs.columns).alias("doc")))
    return marked.join(kept, ["fp", "row"], "left_semi").dropDuplicates(["fp", "row"]).select("doc.*")
