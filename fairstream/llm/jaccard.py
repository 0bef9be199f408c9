"""Near copies by the exact Jaccard similarity of word shingles.

MinHash only says which texts are compared: texts that agree on one of ``BANDS`` keys of ``ROWS``
smallest hashes are linked to the first of their key, and the components of these links are
compared inside. At similarity 0.8 a pair shares no key with probability 4e-7. A pair is a pair
of near copies by its shingle sets alone.

A component of up to ``BLOCK_ROWS`` texts is one block. In a block SimHash fingerprints of the
sets are compared bit-sliced, near pairs are checked first and join their texts, and only what is
still apart is compared by its MinHash values and checked. Shingles no other text of the component
has bound what a text can share, which leaves out most texts that only look alike.

A larger component is thinned before: texts that can share too little with any other go, the text
nearest to the component's majority fingerprint becomes a pivot, and what is near the pivot is
linked to it. ``1 - similarity`` is a metric, so a text left at distance ``d`` is compared only
with texts left or at least ``d - 0.2`` from the pivot. Texts travel once for the pivot, and
once more only where some are left.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairstream.llm.bitslices import near_counts
from fairstream.llm.graph import components
from fairstream.plans.storage import cut, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 28, 4
# pairs whose hashes agree less are not looked at: 4 in 10^10 of the pairs at 0.8
LEAST_AGREED = 0.55
BLOCK_ROWS = 4096
BLOCK_WORDS = 4_000_000
ROWS_A_STEP = 256
BROADCAST_ROWS = 100_000
CHUNK = 512
CACHED_WORDS = 100_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SEEDS = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
TIMES, PLUS = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]


class _Hashes(dict):
    """Word -> hash, emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, hashes: _Hashes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the word shingles; a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    count, width = max(1, len(h) - shingle + 1), min(shingle, len(h))
    total = np.full(count, width, np.uint64)
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + count]
        total ^= total >> np.uint64(32)
    return np.unique(_mixed(total))


def smallest(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each of the ``BANDS * ROWS`` hashes of a set that is not empty."""
    low = np.full(len(TIMES), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        np.minimum(low, (shingles[at : at + CHUNK, None] * TIMES + PLUS).min(0), out=low)
    return low


def majority(shingles: np.ndarray) -> int:
    """The SimHash fingerprint of a set: bits set in over half of its hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        bits = np.unpackbits(shingles[at : at + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def text_keys(text: Column) -> list[Column]:
    """Two numbers, equal for equal texts; zero for texts without words."""
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    return [F.when(worded, F.xxhash64(*own, text)).otherwise(F.lit(0).cast("bigint")) for own in ((), (F.lit("second"),))]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        prints, keys, words, majorities = [], [], [], []
        for fp, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            shingles = shingle_set(text.as_py(), hashes)
            if len(shingles):
                bands = smallest(shingles).reshape(BANDS, ROWS)
                total = np.arange(1, BANDS + 1, dtype=np.uint64)
                for column in bands.T:
                    total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + column)
                prints.append(fp)
                keys.append(total.view(np.int64))
                words.append(len(shingles))
                majorities.append(majority(shingles))
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
        bits = pa.array(np.array(majorities, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), lists, pa.array(words, pa.int64()), bits], ["fp", "keys", "words", "bits"])


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``key, fp`` -> each ``fp`` with the first of its key; no group is held."""
    key, first = None, None
    for batch in batches:
        keys, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(keys):
            continue
        new = np.r_[keys[0] != key, keys[1:] != keys[:-1]]
        starts = np.flatnonzero(new)
        roots = np.r_[prints[:1] if new[0] else [first], prints[starts[starts > 0]]].astype(np.int64)
        root = roots[np.cumsum(new) - int(new[0])]
        key, first = keys[-1], root[-1]
        other = prints != root
        yield pa.RecordBatch.from_arrays([pa.array(root[other]), pa.array(prints[other])], ["a", "b"])


def most_shared(size: np.ndarray, alone: np.ndarray, similarity: float) -> np.ndarray:
    """The largest set that a set of ``size``, ``alone`` of them its own, can be similar enough to."""
    shared = size - alone
    return shared / similarity + shared - size


def near_pairs(sets: list[np.ndarray], side: np.ndarray, alone: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Pairs of near copies that connect all that such pairs connect; with two sides, only across.

    ``alone`` counts the members of each set that no set beyond this block has either; without it
    the block is taken for all there is.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if alone is None:
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        same = flat[order][1:] == flat[order][:-1]
        single = np.empty(len(flat), bool)
        single[order] = ~(np.r_[False, same] | np.r_[same, False])
        alone = np.add.reduceat(single, np.cumsum(size) - size)
    across = side.any() and not side.all()
    shared = size - alone
    parent = np.arange(n)

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    def possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """What sizes and lonely members allow."""
        most = np.minimum(shared[x], shared[y])
        return (most >= similarity * (size[x] + size[y] - most) - 1e-9) & (not across or side[x] != side[y])

    pairs: list[tuple[int, int]] = []

    def check(one: np.ndarray, other: np.ndarray) -> None:
        for x, y in zip(one.tolist(), other.tolist()):
            a, b = top(x), top(y)
            if a == b:
                continue
            both = np.concatenate([sets[x], sets[y]])
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if common >= similarity * (len(both) - common) - 1e-9:
                parent[max(a, b)] = min(a, b)
                pairs.append((x, y))

    bits = np.array([majority(s) for s in sets], np.uint64)
    for one, other, apart in near_counts(bits):
        kept = possible(one, other)
        one, other, apart = one[kept], other[kept], apart[kept]
        order = np.argsort(apart, kind="stable")
        check(one[order], other[order])
    low = np.stack([smallest(s) for s in sets])
    least = LEAST_AGREED * low.shape[1]
    for start in range(0, n, ROWS_A_STEP):
        rows = np.arange(start, min(start + ROWS_A_STEP, n))
        tops = np.array([top(x) for x in range(n)])
        one, other = np.nonzero((tops[rows][:, None] != tops) & (rows[:, None] < np.arange(n)) & possible(rows[:, None], np.arange(n)))
        one = rows[one]
        agreed = np.zeros(len(one), np.int16)
        for column in low.T:
            agreed += column[one] == column[other]
        likely = np.flatnonzero(agreed >= least)
        order = likely[np.argsort(-agreed[likely], kind="stable")]
        check(one[order], other[order])
    return pairs


def _compared(similarity: float):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted ``root, low, high, part, fp, alone, text`` -> links of near copies, block by block."""
        hashes = _Hashes()
        block, held = None, []

        def compare() -> pa.RecordBatch:
            pairs = []
            if len(held) > 1:
                parts, prints, alone, sets = zip(*held)
                known = None if alone[0] is None else np.array(alone)
                pairs = [(prints[x], prints[y]) for x, y in near_pairs(list(sets), np.array(parts) != block[1], known, similarity)]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:6]]
            for root, low, high, part, fp, alone, text in zip(*columns, batch.column(6)):
                if block != (root, low, high):
                    yield compare()
                    block, held = (root, low, high), []
                held.append((part, fp, alone, shingle_set(text.as_py(), hashes)))
        yield compare()

    return links


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``root, fp, text`` -> ``root, fp, shingle``, each member of each set."""
    hashes = _Hashes()
    for batch in batches:
        for root, fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            own = shingle_set(text.as_py(), hashes)
            ends = [pa.array(np.full(len(own), x, np.int64)) for x in (root, fp)]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(own.view(np.int64))], ["root", "fp", "shingle"])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``fp, text, pivot, pivot_text`` -> ``fp, distance``."""
    hashes = _Hashes()
    pivot, against = None, None
    for batch in batches:
        far = []
        prints, pivots = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for i, text in enumerate(batch.column(1)):
            if pivots[i] != pivot:
                pivot, against = pivots[i], shingle_set(batch.column(3)[i].as_py(), hashes)
            own = shingle_set(text.as_py(), hashes)
            common = len(np.intersect1d(own, against, assume_unique=True))
            far.append(1 - common / (len(own) + len(against) - common))
        yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(far, pa.float64())], ["fp", "distance"])


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if its counted rows allow."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def candidates(sketches: DataFrame) -> DataFrame:
    """``fp, keys`` -> ``node, root``: components of texts that share keys.

    A text's links to the firsts of its keys become one link to the least of them and links
    between those, which texts of one family share.
    """
    keys = sketches.select(F.explode("keys").alias("key"), "fp").distinct().repartition("key").sortWithinPartitions("key", "fp")
    firsts = keys.mapInArrow(_firsts, "a bigint, b bigint").groupBy("b").agg(F.collect_set("a").alias("firsts"))
    least = F.array_min("firsts")
    ends = F.array_union(F.array("b"), "firsts")
    return components(firsts.select(least.alias("a"), F.explode(ends).alias("b")).distinct())


def _thinned(crowded: DataFrame, rows: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Crowded components -> links to their pivots, and ``root, fp, alone, text, left`` of texts to compare still.

    ``crowded`` is ``root, fp, words, bits``; ``rows`` is ``fp, text`` of those texts.
    """
    own = stored(rows.join(crowded, "fp"), "jaccard-crowded")
    members = own.select("root", "fp", "text").mapInArrow(_shingles, "root bigint, fp bigint, shingle bigint")
    single = members.groupBy("root", "shingle").agg(F.count("*").alias("n"), F.min("fp").alias("fp")).filter("n = 1")
    alone = cut(single.groupBy("fp").agg(F.count("*").alias("alone")))
    sizes = _small(cut(crowded.groupBy("root").agg(F.min("words").alias("least"), F.max("words").alias("most"))))
    judged = own.join(alone, "fp", "left").withColumn("alone", F.coalesce("alone", F.lit(0))).join(sizes, "root")
    shared = F.col("words") - F.col("alone")
    largest = shared / similarity + shared - F.col("words") + 1e-9
    own = judged.filter((largest >= F.greatest(similarity * F.col("words"), F.col("least"))) & (similarity * F.col("words") <= F.col("most") + 1e-9))
    own = stored(own.select("root", "fp", "alone", "words", "bits", "text"), "jaccard-thinned")
    sums = own.groupBy("root").agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("bits", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)))
    center = F.lit(0).cast("bigint")
    for i in range(64):
        center = center.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)))
    centers = _small(cut(sums.select("root", center.alias("center"))))
    nearest = F.struct(F.bit_count(F.col("bits").bitwiseXOR(F.col("center"))), "fp")
    pivots = cut(own.join(centers, "root").groupBy("root").agg(F.min(nearest)["fp"].alias("pivot")))
    texts = own.select(F.col("fp").alias("pivot"), F.col("text").alias("pivot_text")).join(_small(pivots), "pivot")
    texts = _small(stored(texts.select("root", "pivot", "pivot_text"), "jaccard-pivots"))
    asked = own.join(texts, "root").select("fp", "text", "pivot", "pivot_text")
    far = stored(asked.mapInArrow(_measured, "fp bigint, distance double"), "jaccard-distances")
    placed = own.join(far, "fp").join(_small(pivots), "root")
    reach = 1 - similarity + 1e-9
    links = placed.filter((F.col("distance") <= reach) & (F.col("fp") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("fp").alias("b"))
    left = F.col("distance") > reach
    ring = _small(cut(placed.filter(left).groupBy("root").agg((F.min("distance") - reach).alias("inner"))))
    kept = placed.join(ring, "root").filter(left | (F.col("distance") >= F.col("inner")))
    return links, kept.select("root", "fp", "alone", "words", "text", left.alias("left"))


def _dealt(left: DataFrame, block_rows: int) -> DataFrame:
    """Texts still to compare -> ``root, low, high, part, fp, alone, text``: all blocks with a text that is left."""
    left = stored(left, "jaccard-left")
    parts = F.ceil(F.greatest(F.count("*") / block_rows, F.sum("words") / BLOCK_WORDS)).cast("int")
    counts = left.groupBy("root", "left").agg(parts.alias("n"))
    counts = counts.groupBy("root").agg(F.max(F.when(F.col("left"), F.col("n"))).alias("of_left"), F.coalesce(F.max(F.when(~F.col("left"), F.col("n"))), F.lit(0)).alias("of_near"))
    dealt = left.join(_small(cut(counts)), "root")
    own = F.when(F.col("left"), F.col("of_left")).otherwise(F.col("of_near"))
    part = F.pmod(F.xxhash64("fp", F.lit(7)), own).cast("int") + F.when(F.col("left"), 0).otherwise(F.col("of_left"))
    met = F.when(F.col("left"), F.col("of_left") + F.col("of_near")).otherwise(F.col("of_left"))
    blocks = dealt.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    return blocks.select("root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "fp", "alone", "text")


def near_links(texts: DataFrame, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS, one_each: DataFrame | None = None) -> DataFrame:
    """``fp, text`` -> ``a, b``: links whose components are those of all pairs at ``similarity`` or more.

    Rows of equal ``fp`` have equal texts; of these the texts of the rows in ``one_each`` (by ``fp`` and
    other columns of ``texts``) travel, where it is given. At most two links a text come out of
    each comparison.
    """
    sketches = stored(texts.select("fp", "text").mapInArrow(_keys, "fp bigint, keys array<bigint>, words bigint, bits bigint"), "jaccard-keys")
    sketches = sketches.dropDuplicates(["fp"])
    rough = candidates(sketches.select("fp", "keys"))
    sized = cut(rough.join(sketches.select(F.col("fp").alias("node"), "words", "bits"), "node"))
    sizes = sized.groupBy("root").agg(((F.count("*") > block_rows) | (F.sum("words") > BLOCK_WORDS)).alias("crowded"))
    sized = cut(sized.join(cut(sizes), "root").select(F.col("node").alias("fp"), "root", "words", "bits", "crowded"))
    wanted = sized.select("fp", "root", "crowded")
    wanted = wanted if one_each is None else cut(wanted.join(one_each, "fp"))
    by = ["fp"] if one_each is None else one_each.columns
    met = stored(texts.join(_small(wanted), by).dropDuplicates(["fp"]), "jaccard-texts")
    zero = F.lit(0)
    blocks = met.filter(~F.col("crowded")).select("root", zero.alias("low"), zero.alias("high"), zero.alias("part"), "fp", F.lit(None).cast("bigint").alias("alone"), "text")
    crowded = sized.filter("crowded").select("root", "fp", "words", "bits")
    links = None
    if not crowded.isEmpty():
        links, left = _thinned(crowded, met.filter("crowded").select("fp", "text"), similarity)
        blocks = blocks.unionByName(_dealt(left, block_rows))
    grouped = blocks.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    found = grouped.mapInArrow(_compared(similarity), "a bigint, b bigint")
    return found if links is None else found.unionByName(links)


def near_components(classes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS, one_each: DataFrame | None = None) -> DataFrame:
    """Distinct ``fp`` and the texts ``fp, text`` -> ``classes`` with ``root``, the component of near copies of each."""
    roots = components(near_links(texts, similarity, block_rows, one_each))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
