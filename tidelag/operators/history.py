"""Produced-offset history: merging, retention, compression and run compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelag.functions import int_div
from tidelag.model import SERIES


def valid_samples(responses: DataFrame) -> DataFrame:
    """Samples from offset responses: no error and at least one offset; the first offset counts."""
    return responses.where((F.col("err_code") == 0) & (F.size("offsets") > 0)).select(
        *SERIES, F.get("offsets", F.lit(0)).alias("off"), "at_ms"
    )


def log_end_from_messages(messages: DataFrame) -> DataFrame:
    """Log-end offset of each partition when the input is the messages themselves."""
    return messages.groupBy(*SERIES).agg(
        (F.max("offset") + 1).alias("leo"), F.max("at_ms").alias("leo_at")
    )


def unique_times(samples: DataFrame, time: str = "at_ms") -> DataFrame:
    """One sample per series and time stamp; the higher (later) offset replaces the lower."""
    return (
        samples.where(F.col("off").isNotNull() & F.col(time).isNotNull())
        .groupBy(*SERIES, time)
        .agg(F.max("off").alias("off"))
        .select(*SERIES, "off", time)
    )


def merge_samples(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add a batch of samples; merging the same batch twice changes nothing."""
    return unique_times(old.unionByName(new))


def newest_times(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*SERIES).agg(F.max("at_ms").alias("newest_ms"))


def retain(samples: DataFrame, ttl_seconds: int, now_ms: DataFrame | Column | int | None = None) -> DataFrame:
    """Drop samples older than ``ttl_seconds`` before the newest of their series.

    A sample exactly at the limit is kept.  With ``now_ms`` a series whose
    newest sample is older than the limit is forgotten altogether; it is one
    time for all, or a table (cluster, now_ms) of each cluster's own clock,
    where a cluster without one is forgotten too.
    """
    ttl_ms = ttl_seconds * 1000
    newest = newest_times(samples)
    if isinstance(now_ms, DataFrame):
        clocked = newest.join(now_ms.select("cluster", "now_ms"), "cluster")
        newest = clocked.where(F.col("newest_ms") >= F.col("now_ms") - ttl_ms).drop("now_ms")
    elif now_ms is not None:
        now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
        newest = newest.where(F.col("newest_ms") >= now - ttl_ms)
    # The per-series aggregate is combined map-side, so a hot series is never
    # gathered; the join streams the samples past one small row per series.
    # Dealing the aggregate anew lets Spark split a hot series in the join.
    return (
        samples.join(newest.hint("rebalance"), SERIES)
        .where(F.col("at_ms") >= F.col("newest_ms") - ttl_ms)
        .drop("newest_ms")
    )


def compress(samples: DataFrame) -> DataFrame:
    """One row per sampled offset, with the latest time it was seen."""
    return samples.groupBy(*SERIES, "off").agg(F.max("at_ms").alias("at_ms"))


def compress_text(samples: DataFrame) -> DataFrame:
    """``compress`` for times stored as text: the last text in sort order, then parsed.

    Text that is no integer gives a NULL time; the lag operators treat such a
    sample as unusable rather than absent.
    """
    return (
        unique_times(samples, "member")
        .groupBy(*SERIES, "off")
        .agg(F.max("member").alias("member"))
        .select(*SERIES, "off", F.col("member").try_cast("bigint").alias("at_ms"))
    )


def compact_flat_runs(samples: DataFrame) -> DataFrame:
    """Keep the first and the last sample of every flat run.

    In (offset, time) order a run is exactly the samples of one offset, so the
    two ends come from a combinable aggregate instead of a sort per series.
    """
    ends = samples.groupBy(*SERIES, "off").agg(F.min("at_ms").alias("lo"), F.max("at_ms").alias("hi"))
    return ends.select(*SERIES, "off", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("at_ms"))


def latest_offsets(samples: DataFrame) -> DataFrame:
    """Newest sample of every series: log-end offset and the time it was read."""
    return samples.groupBy(*SERIES).agg(
        F.max_by("off", "at_ms").alias("leo"), F.max("at_ms").alias("leo_at")
    )


def up_to(samples: DataFrame, clocks: DataFrame) -> DataFrame:
    """Samples not later than the clock (cluster, now_ms) of their cluster; without a clock none are known."""
    return samples.join(clocks.select("cluster", "now_ms"), "cluster").where("at_ms <= now_ms").drop("now_ms")


def iteration_ends(iterations: DataFrame, slack_ms: int) -> DataFrame:
    """cluster, snapshot_ms, seen_ms: until when each iteration can have read samples.

    That is ``slack_ms`` after its snapshot, or just before the next iteration of its cluster.
    """
    follows = F.lead("snapshot_ms").over(Window.partitionBy("cluster").orderBy("snapshot_ms"))
    seen = F.least(F.col("snapshot_ms") + slack_ms, follows - 1)  # least() skips NULL
    return iterations.select("cluster", "snapshot_ms").distinct().withColumn("seen_ms", seen)


def read_in_iteration(samples: DataFrame, iterations: DataFrame, slack_ms: int) -> DataFrame:
    """Each sample with the ``snapshot_ms`` of the iteration that read it, at most ``slack_ms`` away.

    That is the last one that had begun by then, or else the next one.  Samples of no iteration are left out.
    Iterations (cluster, snapshot_ms) meet samples by buckets of time, so a sample looks at few of them.
    """
    width = F.lit(slack_ms + 1).cast("bigint")
    near = iterations.select("cluster", "snapshot_ms", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])).alias("k"))
    near = (
        near.groupBy("cluster", (int_div(F.col("snapshot_ms"), width) + F.col("k")).alias("bucket"))
        .agg(F.array_sort(F.collect_set("snapshot_ms")).alias("near"))
    )
    at = F.col("at_ms")
    begun = F.try_element_at(F.filter("near", lambda s: (s <= at) & (s + slack_ms >= at)), F.lit(-1))
    soon = F.get(F.filter("near", lambda s: (s > at) & (s - slack_ms <= at)), F.lit(0))
    met = samples.withColumn("bucket", int_div(at, width)).join(near, ["cluster", "bucket"])
    return met.withColumn("snapshot_ms", F.coalesce(begun, soon)).drop("bucket", "near").where("snapshot_ms is not null")


def series_tail(samples: DataFrame, n: int = 2) -> DataFrame:
    """The ``n`` highest entries of each series in (offset, time) order.

    The rank filter lets Spark cut every series to ``n`` rows before the shuffle.
    """
    order = Window.partitionBy(*SERIES).orderBy(F.desc("off"), F.desc("at_ms"))
    return samples.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
