"""Lag of every consumer group position in offsets and in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelag.functions import LAG_CASE, LAG_OFFSETS, LAG_SECONDS
from tidelag.model import ARRAY_SLICE_BITS, FACT, HOT_ROWS, SERIES, SLICE_BITS
from tidelag.operators.nearest import NEIGHBOURS, nearest_in_arrays, nearest_samples


def _named(committed: DataFrame) -> DataFrame:
    """Positions with a full key; only such a position can be placed in a series."""
    return committed.where(" and ".join(f"{c} is not null" for c in FACT))


def valid_commits(committed: DataFrame) -> DataFrame:
    """Commits reported without an error and with a real offset."""
    return _named(committed).where((F.col("err_code") == 0) & (F.col("c_off") >= 0))


def newest_commits(committed: DataFrame) -> DataFrame:
    """One row per position: its commit of the newest snapshot, the only one that counts in an iteration.

    Combined map-side; of several rows of one snapshot the one with the greatest offset counts.
    """
    rest = [c for c in committed.columns if c not in (*FACT, "snapshot_ms")]
    newest = F.max_by(F.struct(*rest), F.struct("snapshot_ms", "c_off", "err_code"))
    rows = committed.groupBy(*FACT).agg(newest.alias("of_newest"), F.max("snapshot_ms").alias("snapshot_ms"))
    return rows.select(*FACT, "of_newest.*", "snapshot_ms").select(*committed.columns)


def commits_by_snapshot(committed: DataFrame) -> DataFrame:
    """One row per position and snapshot; of several, the one with the greatest offset counts."""
    rest = [c for c in committed.columns if c not in (*FACT, "snapshot_ms")]
    order = F.struct("c_off", "err_code")
    rows = committed.groupBy(*FACT, "snapshot_ms").agg(F.max_by(F.struct(*rest), order).alias("of_greatest"))
    return rows.select(*FACT, "of_greatest.*", "snapshot_ms").select(*committed.columns)


def skip_reason() -> Column:
    """Which offset is missing; NULL when the lag can be computed."""
    return F.nullif(
        F.concat_ws(
            " ",
            F.when(F.col("leo").isNull(), "log_end_unknown"),
            F.when(F.col("c_off").isNull(), "commit_unknown"),
        ),
        F.lit(""),
    )


def with_log_end(committed: DataFrame, latest: DataFrame) -> DataFrame:
    """Attach the log end of each position; unknown where the series was never read.

    ``latest`` is often an aggregate, already dealt by the join key; dealing it
    anew lets Spark split a series that holds very many positions.
    """
    return committed.join(latest.hint("rebalance"), SERIES, "left")


def offset_lag(committed: DataFrame, latest: DataFrame) -> DataFrame:
    """Offset lag where both offsets are known."""
    known = with_log_end(committed, latest).where("leo is not null and c_off is not null")
    return known.selectExpr("*", f"{LAG_OFFSETS} as lag_off")


def missing_offsets(committed: DataFrame, latest: DataFrame) -> DataFrame:
    """Positions that get no lag, with the reason."""
    usable = committed.withColumn("c_off", F.when(F.col("c_off") >= 0, F.col("c_off")))
    return (
        with_log_end(usable, latest)
        .where("leo is null or c_off is null")
        .withColumn("skip_reason", skip_reason())
    )


def with_lag(located: DataFrame) -> DataFrame:
    """Replace neighbour columns by lag_off, lag_s and the way lag_s was found."""
    kept = [c for c in located.columns if c not in NEIGHBOURS]
    return located.selectExpr(
        *kept,
        "leo",
        "leo_at",
        f"{LAG_OFFSETS} as lag_off",
        f"{LAG_CASE} as lag_s_case",
        f"{LAG_SECONDS} as lag_s",
    )


def partition_lag(
    committed: DataFrame,
    samples: DataFrame,
    latest: DataFrame | None = None,
    slice_bits: int = SLICE_BITS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Lag of every valid commit against the sampled history of its series.

    The log end is the newest sample unless ``latest`` gives the one just
    read; a series absent from ``latest`` could not be read and gets no lag.
    """
    placed = nearest_samples(committed, samples, SERIES, slice_bits, hot_rows)
    if latest is not None:
        placed = with_log_end(placed.drop("leo", "leo_at"), latest)
    return with_lag(placed)


def partition_lag_distinct(
    committed: DataFrame, samples: DataFrame, slice_bits: int = SLICE_BITS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``partition_lag`` that looks up each distinct (series, offset) once and joins back.

    Pays off when many groups stand at the same offsets.  The distinct lookups
    are combined map-side; the join back is split by Spark where one offset
    is very popular.
    """
    points = _named(committed).select(*SERIES, "c_off").distinct()
    located = nearest_samples(points, samples, SERIES, slice_bits, hot_rows)
    return with_lag(_named(committed).join(located, [*SERIES, "c_off"], "left"))


def partition_lag_arrays(
    committed: DataFrame, samples: DataFrame, slice_bits: int = ARRAY_SLICE_BITS
) -> DataFrame:
    """``partition_lag`` over array slices; for histories with few samples per slice."""
    return with_lag(nearest_in_arrays(committed, samples, SERIES, slice_bits))


def lag_case_profile(lags: DataFrame) -> DataFrame:
    """How often each way of estimating the time was used."""
    return (
        lags.where("leo is not null")
        .groupBy("lag_s_case")
        .agg(F.count("*").alias("partitions"), F.max("lag_s").alias("max_lag_s"))
    )
