"""The polling loop as a streaming query.

Every micro-batch holds what one iteration read: listed groups, committed
offsets and log-end samples.  Samples enter the history before lag is
computed, so an iteration sees its own samples.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidelag.functions import int_div
from tidelag.model import COMMITS, DEFAULT_INTERVAL, GROUP, SAMPLES
from tidelag.operators.gauges import iteration_gauge
from tidelag.operators.lag import commits_by_snapshot
from tidelag.plans.iteration import iterations_of, published_iterations
from tidelag.streaming.gauge_table import GaugeTable
from tidelag.streaming.history_log import HistoryLog, run_id


def tagged_inputs(groups: DataFrame, commits: DataFrame, samples: DataFrame) -> DataFrame:
    """One stream of all three inputs, told apart by ``kind``.

    Groups and commits carry the ``snapshot_ms`` of the iteration that read them, by the clock of their cluster.
    """
    tag = lambda df, kind: df.withColumn("kind", F.lit(kind))
    return (
        tag(groups.select(*GROUP, "error", "snapshot_ms"), "group")
        .unionByName(tag(commits.select(*COMMITS.fieldNames()), "commit"), allowMissingColumns=True)
        .unionByName(tag(samples.select(*SAMPLES.fieldNames()), "sample"), allowMissingColumns=True)
    )


class LagIteration:
    """Processes one micro-batch: history, then lag and gauges of every iteration in it.

    A micro-batch usually holds one iteration; after a backlog it holds several, and each is published with its own
    ``at_ms``, from what it listed and read itself.  Iterations belong to a cluster and its clock, so one cluster that
    is ahead or behind changes nothing elsewhere.

    History and gauges are keyed by the stream name of ``history``: streams that share folders need different
    names, and so does a stream that starts over with a new checkpoint.
    """

    def __init__(
        self,
        history: HistoryLog,
        gauges_path: str,
        clusters: DataFrame,
        rules: DataFrame,
        extra: Mapping[str, str] | None = None,
        slack_ms: int = 30_000,
        sticky: GaugeTable | None = None,
    ):
        """``slack_ms``: how much later than the snapshot of its commits an iteration may sample the log ends.

        ``sticky``, if given, also keeps the last value of every gauge.
        """
        self.sticky = sticky
        self.slack_ms = slack_ms
        self.history = history
        self.gauges_path = gauges_path
        self.clusters = clusters
        self.rules = rules
        self.extra = extra

    def publish(self, gauges: DataFrame, batch_id: int, part: str) -> None:
        """Store gauges (with at_ms); repeating a batch replaces its rows."""
        (
            gauges.withColumn("day", int_div(F.col("at_ms"), F.lit(86_400_000)))
            .withColumn("stream", F.lit(self.history.stream))
            .withColumn("batch", F.lit(batch_id).cast("bigint"))
            .withColumn("part", F.lit(part))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day", "stream", "batch", "part")
            .parquet(self.gauges_path)
        )

    def publish_duration(self, at_ms: int, seconds: float, batch_id: int) -> None:
        spark = self.history.spark
        gauge = iteration_gauge(spark.range(1).select(F.lit(seconds).alias("seconds")))
        self.publish(gauge.withColumn("at_ms", F.lit(at_ms).cast("bigint")), batch_id, "iteration")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        started, wall_ms = time.monotonic(), int(time.time() * 1000)
        # Inputs without a snapshot belong to an iteration at the wall clock.
        stamped = F.coalesce("snapshot_ms", F.when(F.col("kind") != "sample", F.lit(wall_ms)))
        batch = batch.withColumn("snapshot_ms", stamped.cast("bigint")).persist()
        samples = batch.where("kind = 'sample'").select(*SAMPLES.fieldNames())
        listed = batch.where("kind = 'group'").groupBy(*GROUP, "snapshot_ms").agg(F.max("error").alias("error"))
        groups = listed.persist()
        commits = commits_by_snapshot(batch.where("kind = 'commit'").select(*COMMITS.fieldNames())).persist()
        try:
            self.history.append(samples, batch_id)
            bounds = iterations_of(groups, commits).groupBy("cluster").agg(
                (F.min("snapshot_ms") - self.history.ttl_seconds * 1000).alias("from_ms"),
                (F.max("snapshot_ms") + self.slack_ms).alias("to_ms"),
            )
            gauges = published_iterations(
                groups,
                self.clusters,
                self.rules,
                commits,
                samples,
                self.history.windows(bounds),
                self.history.ttl_seconds,
                self.slack_ms,
                self.extra,
            )
            self.publish(gauges.withColumnRenamed("snapshot_ms", "at_ms"), batch_id, "lag")
            if self.sticky is not None:
                mine = (F.col("stream") == self.history.stream) & (F.col("batch") == batch_id) & (F.col("part") == "lag")
                stored = self.history.spark.read.parquet(self.gauges_path).where(mine)
                self.sticky.add(stored, f"{run_id(batch)}-{batch_id}")
            self.history.close()
            self.history.expire()
            newest = batch.agg(F.max("snapshot_ms")).first()[0]
            self.publish_duration(wall_ms if newest is None else newest, time.monotonic() - started, batch_id)
        finally:
            for kept in (batch, groups, commits):
                kept.unpersist()


class IterationTimes(StreamingQueryListener):
    """Writes the whole time of every micro-batch, as Spark's progress tells it, to the run log and the gauges.

    What ``LagIteration`` can measure itself leaves out planning and the reading of sources.  The run log has one row
    per batch (name, batch, started, duration_ms); repeating a batch replaces its row, and the duration replaces the one
    the iteration has published for the batch.
    """

    SCHEMA = "started string, duration_ms bigint, rows bigint, name string, batch bigint"

    def __init__(self, iteration: LagIteration, run_log: str, name: str):
        self.iteration, self.run_log, self.name = iteration, run_log, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name != self.name or not progress.numInputRows:
            return
        spark, millis = self.iteration.history.spark, int(progress.batchDuration)
        row = (progress.timestamp, millis, progress.numInputRows, progress.name, progress.batchId)
        (
            spark.createDataFrame([row], self.SCHEMA)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("name", "batch")
            .parquet(self.run_log)
        )
        mine = (F.col("batch") == progress.batchId) & (F.col("part") == "iteration")
        stream = F.col("stream") == self.iteration.history.stream
        at_ms = spark.read.parquet(self.iteration.gauges_path).where(mine & stream).agg(F.max("at_ms")).first()[0]
        if at_ms is not None:
            self.iteration.publish_duration(at_ms, millis / 1000, progress.batchId)


def start_lag_stream(
    inputs: DataFrame,
    iteration: LagIteration,
    name: str,
    checkpoint: str | None = None,
    interval: str | None = DEFAULT_INTERVAL,
) -> StreamingQuery:
    """Run an iteration per ``interval``, or over everything available when it is None.

    ``name`` identifies the stream across restarts.  Progress is kept under
    ``checkpoint``, by default under that name in the shared folder the cluster
    sets as ``spark.checkpoint.dir``.
    """
    if checkpoint is None:
        shared = inputs.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared:
            raise ValueError("name a checkpoint folder or set spark.checkpoint.dir")
        checkpoint = f"{shared.rstrip('/')}/{name}"
    writer = inputs.writeStream.queryName(name).foreachBatch(iteration).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def session_stream(beats: DataFrame, ttl: str, lateness: str) -> DataFrame:
    """Member sessions from a stream of beats (member, ts TIMESTAMP), final once closed."""
    session = F.session_window("ts", ttl)
    return (
        beats.withWatermark("ts", lateness)
        .groupBy("member", session)
        .agg(F.count("*").alias("beats"))
        .select(
            "member",
            F.unix_millis("session_window.start").alias("start_ms"),
            F.unix_millis("session_window.end").alias("end_ms"),
            "beats",
        )
    )
