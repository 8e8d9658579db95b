"""Service members: sessions from heartbeats, liveness and registration order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelag.functions import int_div


def sessions(beats: DataFrame, ttl_ms: int) -> DataFrame:
    """Spans in which a member kept refreshing within its time to live.

    Same spans as ``session_window``: a beat at most ``ttl_ms`` after the
    previous one extends the session, which ends ``ttl_ms`` after its last beat.
    Beats are first folded map-side into cells of ``ttl_ms``; beats of a cell
    always belong together.  A member therefore sorts at most one row per cell
    however often it beats.
    """
    cells = (
        beats.groupBy("member", int_div(F.col("at_ms"), F.lit(ttl_ms)).alias("cell"))
        .agg(
            F.min("at_ms").alias("first_ms"),
            F.max("at_ms").alias("last_ms"),
            F.count("*").alias("beats"),
        )
    )
    order = Window.partitionBy("member").orderBy("cell")
    gap = F.col("first_ms") - F.lag("last_ms").over(order)
    opened = cells.withColumn("opens", F.when(gap <= ttl_ms, 0).otherwise(1))
    return (
        opened.withColumn("session", F.sum("opens").over(order))
        .groupBy("member", "session")
        .agg(
            F.min("first_ms").alias("start_ms"),
            (F.max("last_ms") + F.lit(ttl_ms)).alias("end_ms"),
            F.sum("beats").alias("beats"),
        )
        .drop("session")
    )


def live_members(events: DataFrame, ttl_ms: int, now_ms: Column) -> DataFrame:
    """Members alive at ``now_ms`` with the time they registered.

    A leave takes effect at once and ends the registration; a later beat
    registers the member anew.  ``events`` has member, kind and at_ms; what
    happens after ``now_ms`` is not known yet.
    """
    events = events.where(F.col("at_ms") <= now_ms)
    left = events.where("kind = 'leave'").groupBy("member").agg(F.max("at_ms").alias("left_ms"))
    beats = (
        events.where("kind = 'beat'")
        .join(left.hint("rebalance"), "member", "left")
        .where(F.col("left_ms").isNull() | (F.col("at_ms") > F.col("left_ms")))
    )
    current = sessions(beats, ttl_ms).where(F.col("end_ms") > now_ms)
    return current.groupBy("member").agg(F.max("start_ms").alias("first_seen_ms"))


def member_index(live: DataFrame, bucket_ms: int = 60000) -> DataFrame:
    """Zero-based position of each live member in registration order, and the member count.

    Members are numbered inside their millisecond, milliseconds inside their
    bucket, and only one count per bucket passes through the single running total.
    """
    placed = live.withColumn("bucket", int_div(F.col("first_seen_ms"), F.lit(bucket_ms)))
    moments = placed.groupBy("bucket", "first_seen_ms").agg(F.count("*").alias("n"))
    buckets = moments.groupBy("bucket").agg(F.sum("n").alias("n"))
    starts = buckets.select(
        "bucket",
        F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    earlier = Window.partitionBy("bucket").orderBy("first_seen_ms").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        moments.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(starts, "bucket")
        .select("first_seen_ms", (F.col("base") + F.col("ahead")).alias("base"), "total")
    )
    inside = Window.partitionBy("first_seen_ms").orderBy("member")
    return (
        live.withColumn("place", F.row_number().over(inside))
        .join(bases, "first_seen_ms")
        .select(
            "member",
            (F.col("base") + F.col("place") - 1).alias("member_index"),
            F.col("total").alias("members"),
        )
    )
