"""Folded sinks: batch folders merged into a snapshot.

A stream that writes one folder a micro-batch grows without end, and reading
it replays all history.  Here a sink is a log-structured merge of two levels:

* ``batch_id=N``: the open tail, one folder a micro-batch;
* ``_folded/through=K``: the snapshot, everything up to batch K merged.

Spark writes a snapshot's ``_SUCCESS`` file last, so the largest complete
``through`` is the marker of the last folded batch: an unfinished fold is not
seen, and is written anew by the next one.  A batch replayed after a lost
commit rewrites its own folder, or is ignored when it is already folded, so
every batch counts once.  A fold removes what it replaced; a reader that began
before it has to start again.

Merging is associative, so the snapshot is merged with the tail like one more
batch: the last row a key (``latest``) or sums and sketch unions (``summed``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import last_per_key
from ..session import list_folder, remove_folder

EVERY = 10  # batches in the open tail before they are folded
Merge = Callable[[DataFrame], DataFrame]


def latest(keys: list[str]) -> Merge:
    """The row of the last batch per key; null keys are keys like others."""
    def merge(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in keys]
        packed = rows.select(F.struct(*keys).alias("_k"), *others)
        last = last_per_key(packed, "_k", "batch_id")
        return last.select(*[F.col(f"_k.{k}").alias(k) for k in keys], *[c for c in others if c != "batch_id"])
    return merge


def summed(keys: list[str], sums: list[str], sketches: list[str] = ()) -> Merge:
    """Sums, and unions of HyperLogLog sketches, per key."""
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in sums], *[F.hll_union_agg(c).alias(c) for c in sketches])
    return merge


@dataclass(frozen=True)
class FoldedSink:
    path: str
    merge: Merge
    every: int = EVERY

    def folded_through(self, spark: SparkSession) -> int:
        """The last folded batch; -1 before the first fold."""
        done = [-1]
        for name in list_folder(spark, f"{self.path}/_folded"):
            if name.startswith("through=") and "_SUCCESS" in list_folder(spark, f"{self.path}/_folded/{name}"):
                done.append(int(name.removeprefix("through=")))
        return max(done)

    def tail(self, spark: SparkSession) -> list[int]:
        """Batches that are not folded yet."""
        through = self.folded_through(spark)
        ids = [int(n.removeprefix("batch_id=")) for n in list_folder(spark, self.path) if n.startswith("batch_id=")]
        return sorted(i for i in ids if i > through)

    def read(self, spark: SparkSession) -> DataFrame:
        """The merged rows of all batches written so far."""
        through, parts = self.folded_through(spark), []
        if through >= 0:
            parts.append(spark.read.parquet(f"{self.path}/_folded/through={through}").withColumn(
                "batch_id", F.lit(through)))
        open_batches = [f"{self.path}/batch_id={i}" for i in self.tail(spark)]
        if open_batches:
            parts.append(spark.read.option("basePath", self.path).parquet(*open_batches).withColumn(
                "batch_id", F.col("batch_id").cast("int")))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return self.merge(rows)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Write a micro-batch (for ``foreachBatch``); fold a full tail."""
        spark = batch.sparkSession
        through = self.folded_through(spark)
        if batch_id <= through:
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        if len(self.tail(spark)) >= self.every:
            self.fold(spark)

    def fold(self, spark: SparkSession) -> None:
        """Merge the tail into a new snapshot and remove what it replaces."""
        before, batches = self.folded_through(spark), self.tail(spark)
        if not batches:
            return
        self.read(spark).write.mode("overwrite").parquet(f"{self.path}/_folded/through={batches[-1]}")
        for i in batches:
            remove_folder(spark, f"{self.path}/batch_id={i}")
        if before >= 0:
            remove_folder(spark, f"{self.path}/_folded/through={before}")
