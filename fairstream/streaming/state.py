"""Stream state as one small table per micro-batch, folded into snapshots.

Batch ``k`` overwrites ``<root>/<table>/batch_id=k`` and reads only batches before ``k``, so
running a batch again changes nothing. The ``sizes`` row is written last: a batch without one has
not happened.

Every few batches all but the last are folded into one snapshot: a table of what the job's answers
need of them. A manifest of a new version names the snapshot and its last batch; only then are the
folded batches and the snapshot before it deleted. Whoever reads goes by the newest manifest and
leaves out older batches, so a stop between any two of these steps does no harm. A folded batch that
is run again is answered by the snapshot: it is done, and nothing is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairstream.plans.storage import names_in, remove

SIZES = "size bigint, total bigint"
MANIFEST = "upto bigint, snapshot string"
COMPACT_EVERY = 32

Fold = Callable[[DataFrame], DataFrame]


class BatchState:
    """``folds`` says for each table what a snapshot keeps of its rows, which have ``batch_id``; by default all."""

    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, str], folds: Mapping[str, Fold] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas, self.folds = {**schemas, "sizes": SIZES}, dict(folds or {})
        for table, schema in self.schemas.items():
            # an empty partition makes every table readable from the start
            if "batch_id=-1" not in names_in(spark, f"{self.root}/{table}"):
                self.spark.createDataFrame([], schema).write.mode("ignore").parquet(
                    f"{self.root}/{table}/batch_id=-1"
                )
        self.version, self.upto, self.snapshot = self._newest()

    def _newest(self) -> tuple[int, int, str | None]:
        """Version, last folded batch and snapshot by the newest manifest; a job only where there is one."""
        versions = [int(name.removeprefix("version=")) for name in names_in(self.spark, f"{self.root}/manifest") if name.startswith("version=")]
        for version in sorted(versions, reverse=True):
            row = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/version={version}").head()
            if row:  # else its write was cut off
                return version, row.upto, row.snapshot
        return -1, -1, None

    def is_folded(self, batch_id: int) -> bool:
        """Whether a snapshot holds what this batch did."""
        return batch_id <= self.upto

    def compact(self, upto: int) -> None:
        """Fold all batches up to ``upto`` into a new snapshot and delete what it replaces."""
        if upto <= self.upto:
            return
        old = (self.version, self.upto, self.snapshot)
        snapshot = f"{self.root}/snapshots/{upto}-{uuid.uuid4().hex}"
        for table in self.schemas:
            kept = self.committed(table) if table != "sizes" else self.read("sizes")
            kept = self.folds.get(table, lambda df: df)(kept.filter(F.col("batch_id") <= upto))
            kept.coalesce(1 if table == "sizes" else 8).write.parquet(f"{snapshot}/{table}")
        row = self.spark.createDataFrame([(upto, snapshot)], MANIFEST)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={old[0] + 1}")
        self.version, self.upto, self.snapshot = old[0] + 1, upto, snapshot
        for batch_id in range(old[1] + 1, upto + 1):
            for table in self.schemas:
                remove(self.spark, f"{self.root}/{table}/batch_id={batch_id}")
        if old[2]:
            remove(self.spark, f"{self.root}/manifest/version={old[0]}")
            remove(self.spark, old[2])

    def compact_if_due(self, batch_id: int, every: int | None = None) -> None:
        """After batch ``batch_id``; it and its input stay as they are, since it may be run again."""
        if batch_id - self.upto > (COMPACT_EVERY if every is None else every):
            self.compact(batch_id - 1)

    def write(self, table: str, batch_id: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/batch_id={batch_id}")

    def write_all(self, batch_id: int, **tables: Callable[[], DataFrame]) -> None:
        """Several tables of a batch, each made and written side by side with the others."""
        with ThreadPoolExecutor(len(tables)) as pool:
            jobs = [pool.submit(lambda name=name, made=made: self.write(name, batch_id, made())) for name, made in tables.items()]
            for job in jobs:
                job.result()

    def commit(self, batch_id: int, size: int, total: int) -> None:
        row = self.spark.range(0, 1, 1, 1).selectExpr(f"{size}L AS size", f"{total}L AS total")
        self.write("sizes", batch_id, row)

    def read(self, table: str) -> DataFrame:
        """All batches, with ``batch_id``, folded ones as the snapshot has them; filters on it prune directories."""
        schema = f"{self.schemas[table]}, batch_id bigint"
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        if self.snapshot is None:
            return rows
        folded = self.spark.read.schema(schema).parquet(f"{self.snapshot}/{table}")
        return folded.unionByName(rows.filter(F.col("batch_id") > self.upto))

    def read_batch(self, table: str, batch_id: int) -> DataFrame:
        """One batch by its path, without listing the others; empty if it was not written."""
        schema = self.schemas[table]
        if self.snapshot is not None and batch_id <= self.upto:
            rows = self.spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{self.snapshot}/{table}")
            return rows.filter(F.col("batch_id") == batch_id).drop("batch_id")
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/batch_id={batch_id}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def last_before(self, batch_id: int) -> tuple[int, int]:
        """Latest committed batch before this one and the stream length after it.

        That is the batch just before, found by its path: batches follow on one another and
        each commits. Only a state that was begun later, or torn, is searched.
        """
        newest = self.read_batch("sizes", batch_id - 1).head()
        if newest:
            return batch_id - 1, newest.total
        row = (
            self.read("sizes")
            .filter(F.col("batch_id") < batch_id)
            .agg(F.max_by("total", "batch_id"), F.max("batch_id"))
            .head()
        )
        return (-1, 0) if row[1] is None else (row[1], row[0])

    def committed(self, table: str) -> DataFrame:
        done = self.read("sizes").select("batch_id")
        # what a snapshot holds was committed; a fold may keep any batch's number for it
        return self.read(table).join(done, "batch_id", "left_semi")

    def sizes(self) -> DataFrame:
        """``batch_id, size`` of the batches that were not empty."""
        return self.read("sizes").filter("size > 0").select("batch_id", "size")
