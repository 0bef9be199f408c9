"""Distance of every point to its closest center, and the k-center radius."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairstream.functions.distance import MAX_TERMS, nearest_to_known
from fairstream.functions.nearest import nearest_in_batches
from fairstream.plans.storage import stored

CENTER_BYTES = 64 << 20


def _with_squared(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Add ``md``, the squared distance to the closest center, in one narrow pass.

    A handful of centers becomes literals; more travel in the closure of an Arrow function, up to
    ``CENTER_BYTES``. Only beyond that are they dealt by hash into blocks of about that size,
    with the distance so far written to the shared folder in between.
    """
    shape = centers.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("coords")).alias("low"), F.max(F.size("coords")).alias("high")).head()
    if not shape.n:
        raise ValueError("no centers")
    if shape.low != shape.high:
        raise ValueError(f"centers have between {shape.low} and {shape.high} coordinates")
    if shape.n * max(1, shape.high) <= MAX_TERMS:
        return points.withColumn("md", nearest_to_known([r.coords for r in centers.select("coords").collect()]))
    blocks = -(-shape.n * 8 * max(1, shape.high) // CENTER_BYTES)
    dealt = centers.select("coords", F.pmod(F.xxhash64("coords"), F.lit(blocks)).alias("block"))
    out, carried = points, None
    for number in range(blocks):
        block = dealt.filter(F.col("block") == number).select("coords").toArrow()["coords"].combine_chunks()
        if not len(block):
            continue
        if carried is not None:
            out = stored(out, "distances")
        known = block.flatten().to_numpy().reshape(len(block), shape.high)
        out = out.withColumn("md", nearest_in_batches(F.col("coords"), known, carried))
        carried = F.col("md")
    return out


def nearest_center(points: DataFrame, centers: DataFrame) -> DataFrame:
    """``points`` with ``distance``; ``centers`` needs only ``coords``."""
    return _with_squared(points, centers).withColumn("distance", F.sqrt("md")).drop("md")


def objective(points: DataFrame, centers: DataFrame) -> DataFrame:
    """One row ``objective``: the largest distance; NULL without points.

    The root is taken once, after the maximum.
    """
    far = _with_squared(points.select("coords"), centers)
    return far.agg(F.sqrt(F.max("md")).alias("objective"))
