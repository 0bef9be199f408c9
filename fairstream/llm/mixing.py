"""Mixing sources to target weights along a curriculum.

Every source has a share of the words and a weight schedule over training time. The integral of
the schedule is the source's cumulative demand; a document's place in its source's supply (an
order by a hash of its id and text) is turned into a training position by inverting that integral.

Supply is summed by source and hash prefix, so no window ever holds the rows of a source: a
document needs the sums before its prefix, and only the one prefix in which a source's target is
reached is looked at by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairstream.plans.storage import cut, stored

WEIGHTS = (3, 1, 2)
SLOPES = (0.5, 0.0, -0.5)
SHARE = 1.5
MOST = 2
PREFIX = 3
DIGITS = 9
#: Of the mixing table, one row per source and prefix.
ROW_BYTES, BROADCAST_BYTES = 160, 32 << 20
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def supply_key(doc_id: Column, text: Column) -> Column:
    """Place of a document in the supply of its source; rows that repeat both id and text share it."""
    own = F.coalesce(F.md5(text.cast("binary")), F.lit(""))
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), own).cast("binary"))


def _by_rank(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, size`` -> one row per source with its size, target, whole epochs and remainder.

    Sources by code point, null last, take the weights in turn. A target stops at ``MOST``
    times its source; what is left over goes to the others by weight (filled in order of the
    level at which each source is full).
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything, filling = Window.partitionBy(), Window.orderBy("level", "rank")
    ranked = one.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", _by_rank(WEIGHTS, F.col("rank")).cast("bigint")).withColumn("slope", _by_rank(SLOPES, F.col("rank")))
    cap = F.col("source_size") * MOST
    ranked = ranked.withColumn("level", cap.cast("double") / F.col("weight")).withColumn("wanted", F.sum("source_size").over(everything) * F.lit(SHARE))
    ranked = ranked.withColumn("before", F.coalesce(F.sum(cap).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("weights_left", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("full", cap * F.col("weights_left") <= (F.col("wanted") - F.col("before")) * F.col("weight"))
    used = F.coalesce(F.sum(F.when(F.col("full"), cap)).over(everything), F.lit(0))
    sharing = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    shared = (F.col("wanted") - used) * F.col("weight") / sharing
    ranked = ranked.withColumn("target", F.when(F.col("full"), cap.cast("double")).otherwise(shared))
    whole = F.when(F.col("source_size") == 0, F.lit(1)).otherwise(F.floor(F.col("target") / F.col("source_size")))
    ranked = ranked.withColumn("epochs", whole.cast("bigint"))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    return ranked.select("source", "source_size", "slope", "target", "epochs", rest.alias("rest"))


def supply(sized: DataFrame) -> DataFrame:
    """``source, key, size`` -> the mixing table, one row per source and key prefix.

    ``last_key`` is the key up to which a source's documents are taken once more than
    ``epochs`` times: the key whose middle is the last that the remainder of the target covers.
    """
    sources = cut(source_targets(sized.select("source", "size")))
    prefix = F.substring("key", 1, PREFIX).alias("prefix")
    sums = sized.groupBy("source", prefix).agg(F.sum("size").alias("prefix_size"))
    so_far = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("prefix_size").over(so_far), F.lit(0)))
    same = sums["source"].eqNullSafe(sources["source"])
    table = cut(sums.join(sources, same).drop(sources["source"]))
    cutting = table.filter("before <= rest AND rest < before + prefix_size").select("source", "prefix", "before", "rest")
    cutting = cutting.toDF("cut_source", "cut_prefix", "cut_before", "rest")
    inside = sized.join(cutting, sized["source"].eqNullSafe(cutting["cut_source"]) & (F.substring("key", 1, PREFIX) == F.col("cut_prefix")))
    keys = inside.groupBy("cut_source", "cut_prefix", "cut_before", "rest", "key").agg(F.sum("size").alias("size"))
    in_source = Window.partitionBy("cut_source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("cut_before") + F.sum("size").over(in_source) - F.col("size") / 2
    reached = keys.withColumn("middle", middle).filter("middle <= rest").groupBy("cut_source").agg(F.max("key").alias("reached"))
    last = cutting.join(reached.withColumnRenamed("cut_source", "r"), F.col("cut_source").eqNullSafe(F.col("r")), "left")
    last = cut(last.select("cut_source", F.coalesce("reached", "cut_prefix").alias("last_key")))
    joined = table.join(last, table["source"].eqNullSafe(last["cut_source"]), "left").drop("cut_source")
    # without a cutting prefix the remainder is nothing (or, by rounding, the whole supply)
    none = F.when(F.col("rest") > 0, F.lit("g")).otherwise(F.lit(""))
    return cut(joined.withColumn("last_key", F.coalesce("last_key", none)))


def _position(words: Column) -> Column:
    """When the demand of a source reaches ``words``: the inverse of t + slope (t*t - t), in [0, 1]."""
    y, a = F.least(words / F.col("target"), F.lit(1.0)), F.col("slope")
    return 2 * y / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * y))


def placed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with ``source`` and ``key``, plus the mixing table's columns, ``copies`` and ``first``, ``second``."""
    other = table.withColumnRenamed("source", "table_source")
    other = F.broadcast(other) if other.count() * ROW_BYTES <= BROADCAST_BYTES else other
    met = rows.join(other, rows["source"].eqNullSafe(other["table_source"]) & (F.substring("key", 1, PREFIX) == other["prefix"])).drop("table_source", "prefix")
    met = met.withColumn("copies", F.col("epochs") + (F.col("key") <= F.col("last_key")).cast("bigint"))
    inner = F.conv(F.substring("key", PREFIX + 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)
    at = F.col("before") + inner * F.col("prefix_size")
    first = F.when((F.col("copies") > 0) & (F.col("target") > 0), _position(at))
    second = F.when((F.col("copies") > 1) & (F.col("target") > 0), _position(F.col("source_size") + at))
    return met.withColumn("first", first).withColumn("second", second)


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"), supply_key(F.col("doc_id"), F.col("text")).alias("key"),
    )


def mix_plan(docs: DataFrame) -> DataFrame:
    """``doc_id, text, source`` -> ``doc_id, size, source_size, target, taken, position``.

    One row per row, sorted by ``position``: when training first reads the document (null if it
    is not taken, or if its source has no words). A source with a null name is a source; a null
    text has no words. Rows that repeat an id and its text are taken alike; rows without an id are
    dealt by their texts. An empty table gives an empty result; other columns are not read. The
    order of supply depends on ids and texts only.
    """
    sized = stored(sized_documents(docs), "mix-sizes")
    found = placed(sized, supply(sized))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return found.select("doc_id", "size", "source_size", "target", taken, F.col("first").alias("position")).orderBy(
        F.col("position").asc_nulls_last(), "doc_id"
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix in training order, with the columns of ``docs``.

    A document read in two epochs is two rows. The texts are shuffled once, for the order. Null and
    empty texts have no words, so they come as often as their source's whole epochs say; a source
    without words comes last. Repeated rows are taken alike, an empty table gives an empty result.
    """
    columns = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    sized = stored(sized_documents(docs), "mix-sizes")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("source").cast("string").alias("source"), supply_key(F.col("doc_id"), F.col("text")).alias("key")
    )
    found = placed(rows, supply(sized))
    # a source without words has no demand to follow: its rows come last
    place = F.when(F.col("copies") > 1, F.array("first", "second")).when(F.col("copies") > 0, F.array("first"))
    repeated = found.select("doc", F.explode(place).alias("position"))
    return repeated.orderBy(F.col("position").asc_nulls_last(), "doc.doc_id").select(*columns)
