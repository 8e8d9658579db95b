"""Produced-offset history kept as an append-only parquet log.

Each micro-batch adds only its own samples, under
``open/written=<hour>/stream=<name>/run=<id>/bucket=<time>/batch=<id>``, so streams that
share a path keep apart, a stream that starts over with a new checkpoint gets a
new run, and a repeated batch replaces its own files (or, in another hour,
repeats rows that reading folds).  Once an hour of writing is over, ``close``
rewrites its many small files to a few under ``closed/written=<hour>``.  Reading folds
equal samples, so a stop at any point of that leaves the history as it is.
Retention is applied per series on reading.  Files are deleted by the age of
their writing alone, never by the times in the data, so one clock that is ahead
cannot remove the history of others.  The path must be on storage every
executor can reach.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.functions import int_div
from tidelag.model import DEFAULT_TTL_SECONDS, SAMPLES, SERIES
from tidelag.operators.history import retain, unique_times, up_to
from tidelag.streaming import files


HOUR_MS = 3_600_000  # width of a bucket and of a span of writing, whatever the retention


def run_id(batch: DataFrame) -> str:
    """The id of the streaming query whose micro-batch is at hand; it stays with its checkpoint, and is new with a new one."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def _wall_ms() -> int:
    return int(time.time() * 1000)


class HistoryLog:
    def __init__(
        self, spark: SparkSession, path: str, ttl_seconds: int = DEFAULT_TTL_SECONDS, stream: str = "main"
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.open, self.closed = f"{self.path}/open", f"{self.path}/closed"
        self.ttl_seconds = ttl_seconds
        self.stream = stream

    def append(self, samples: DataFrame, batch_id: int) -> None:
        """Add the samples of one micro-batch; repeating a batch id replaces that batch."""
        known = samples.where("off is not null and at_ms is not null").select(*SERIES, "off", "at_ms")
        (
            known.withColumn("bucket", int_div(F.col("at_ms"), F.lit(HOUR_MS)))
            .withColumn("written", F.lit(_wall_ms() // HOUR_MS).cast("bigint"))
            .withColumn("stream", F.lit(self.stream))
            .withColumn("run", F.lit(run_id(samples)))
            .withColumn("batch", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("written", "stream", "run", "bucket", "batch")
            .parquet(self.open)
        )

    def _read(self, *folders: list[str]) -> DataFrame:
        """Samples and their ``bucket`` of folders of different layouts."""
        schema = f"{SAMPLES.toDDL()}, bucket bigint"
        columns = [*SAMPLES.fieldNames(), "bucket"]
        parts = [self.spark.read.schema(schema).parquet(*paths).select(*columns) for paths in folders if paths]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def _hours(self, root: str) -> list[int]:
        return [int(n[8:]) for n in files.names(self.spark, root) if n.startswith("written=")]

    def close(self, wall_ms: int | None = None) -> int:
        """Rewrite the hours of writing that are over, one job each; returns how many hours were closed.

        The new files are complete before the old ones go, and what was closed of an hour before is merged again.
        """
        hour = (_wall_ms() if wall_ms is None else wall_ms) // HOUR_MS
        done = [h for h in self._hours(self.open) if h < hour]
        for h in done:
            target = f"{self.closed}/written={h}"
            versions = files.complete(self.spark, target)
            rows = self._read([f"{self.open}/written={h}"], [f"{target}/{v}" for v in versions])
            newer = 1 + max((int(v[8:]) for v in versions), default=0)
            (
                unique_times(rows)
                .withColumn("bucket", int_div(F.col("at_ms"), F.lit(HOUR_MS)))
                .hint("rebalance", "bucket")  # few files per bucket, large ones split
                .write.mode("overwrite")
                .partitionBy("bucket")
                .parquet(f"{target}/version={newer}")
            )
            files.delete(self.spark, f"{self.open}/written={h}")
            for v in files.names(self.spark, target):
                if v != f"version={newer}":
                    files.delete(self.spark, f"{target}/{v}")
        return len(done)

    def _stored(self, from_ms: int, to_ms: int) -> DataFrame:
        buckets = F.col("bucket").between(from_ms // HOUR_MS, to_ms // HOUR_MS)
        open_hours = [f"{self.open}/written={h}" for h in self._hours(self.open)]
        closed = [
            f"{self.closed}/written={h}/{v}"
            for h in self._hours(self.closed)
            for v in files.complete(self.spark, f"{self.closed}/written={h}")
        ]
        return self._read(open_hours, closed).where(buckets).where(F.col("at_ms").between(from_ms, to_ms))

    def read(self, now_ms: int | DataFrame) -> DataFrame:
        """History as of ``now_ms``: retained samples of series that have not expired; later ones stay unread.

        ``now_ms`` is one time for all, or a table (cluster, now_ms): each cluster is then read by its own clock, and
        one without a clock has no history.
        """
        # A series is kept while its newest sample is within the retention, and
        # then reaches back one more retention from that sample.
        back = 2 * self.ttl_seconds * 1000
        if not isinstance(now_ms, DataFrame):
            return retain(unique_times(self._stored(now_ms - back, now_ms)), self.ttl_seconds, now_ms)
        first, last = now_ms.agg(F.min("now_ms"), F.max("now_ms")).first()
        stored = self._stored(0 if first is None else first - back, 0 if last is None else last)
        return retain(unique_times(up_to(stored, now_ms)), self.ttl_seconds, now_ms)

    def windows(self, bounds: DataFrame) -> DataFrame:
        """Samples of each cluster between its ``from_ms`` and ``to_ms``, both included: (cluster, from_ms, to_ms)."""
        first, last = bounds.agg(F.min("from_ms"), F.max("to_ms")).first()
        stored = self._stored(first or 0, last or 0).join(bounds, "cluster")
        return unique_times(stored.where("at_ms between from_ms and to_ms"))

    def expire(self, wall_ms: int | None = None) -> int:
        """Delete files written more than two retentions before the wall clock; returns how many hours went."""
        oldest = ((_wall_ms() if wall_ms is None else wall_ms) - 2 * self.ttl_seconds * 1000) // HOUR_MS
        old = [(root, h) for root in (self.open, self.closed) for h in self._hours(root) if h < oldest]
        for root, h in old:
            files.delete(self.spark, f"{root}/written={h}")
        return len({h for _, h in old})
