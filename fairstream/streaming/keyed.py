"""Sticky sampling as native keyed state of Structured Streaming.

Each item is a key. Until one of its arrivals wins the coin nothing is known of it; from then on its
state is the number of its arrivals. The state lives in Spark's checkpointed store, so a micro-batch is
one job, and a replay starts from the state before it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fairstream.functions.hashing import draw
from fairstream.operators.frequency import Frequency

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StickyCount(StatefulProcessor):
    """``item``: its arrivals ``seq, won`` of a micro-batch -> ``item, n`` once it is sampled."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        found = self.count.get() if self.count.exists() else None
        if found is not None:
            total = int(found[0]) + sum(len(chunk) for chunk in rows)
        else:
            total = arrivals_since_win(rows)
        if total:
            self.count.update((total,))
            yield pd.DataFrame({"item": [key[0]], "n": [total]})

    def close(self) -> None:
        pass


def arrivals_since_win(chunks: Iterator[pd.DataFrame]) -> int:
    """Arrivals from the first winning one on, in any order of the chunks; 0 if none wins.

    Only arrivals before the first win so far are held, some ``1 / rate`` of them.
    """
    first, since, before = None, 0, np.zeros(0, np.int64)
    for chunk in chunks:
        seq, won = chunk["seq"].to_numpy(), chunk["won"].to_numpy(dtype=bool)
        wins = seq[won]
        if len(wins) and (first is None or wins.min() < first):
            first = int(wins.min())
            since += int((before >= first).sum())
            before = before[before < first]
        if first is not None:
            since += int((seq >= first).sum())
            seq = seq[seq < first]
        before = np.concatenate([before, seq])
    return since


def streaming_sticky_sample(items: DataFrame, run: Frequency) -> DataFrame:
    """``seq, item`` of a stream -> ``item, n`` of items as they are sampled and grow, in update mode.

    ``seq`` numbers the arrivals from 0 and rises from batch to batch; those from ``run.n`` on are left
    out. The session must use the RocksDB state store (``keyed_state``).
    """
    won = draw(run.seed, F.col("seq").cast("string")) <= F.lit(run.winning)
    arrivals = items.filter((F.col("seq") >= 0) & (F.col("seq") < run.n)).select("item", "seq", won.alias("won"))
    return arrivals.groupBy("item").transformWithStateInPandas(
        statefulProcessor=StickyCount(), outputStructType="item bigint, n bigint", outputMode="Update", timeMode="None"
    )


class keyed_state:  # noqa: N801
    """A block in which queries start with the state store that keyed state needs."""

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(STORE, None)
        self.conf.set(STORE, ROCKS)

    def __exit__(self, *_: object) -> None:
        if self.before is None:
            self.conf.unset(STORE)
        else:
            self.conf.set(STORE, self.before)
