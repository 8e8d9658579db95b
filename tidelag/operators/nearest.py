"""Nearest-sample lookup: for an offset, the samples just below and above it.

This is an as-of join in both directions.  Sorting samples and lookups together
per series would put a hot series into one task, and an equi-join on the series
would emit every (lookup, sample) pair, so the work is cut by *offset slice*:

1. samples are folded to one row per (series, offset) with map-side combining,
   so a slice of ``2**slice_bits`` offsets holds at most that many of them;
2. lookups are counted per slice; a slice asked more than ``hot_rows`` times is
   split into several copies, each with all samples of the slice and a share
   of its lookups;
3. two edge rows per slice carry the neighbouring samples of other slices and
   facts about the whole series;
4. one sort per (series, slice, copy) then finds both neighbours of every lookup.

Lookups cross the network once.  Samples must be unique per (key, at_ms), which
the history operators guarantee.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.model import ARRAY_SLICE_BITS, HOT_ROWS, MAX_HOT_SLICES, SERIES, SLICE_BITS

FACTS = ["min_off", "max_off", "bad_off", "leo", "leo_at"]
NEIGHBOURS = ["lo_off", "lo_at", "up_off", "up_at", *FACTS]


def _named(rows: DataFrame, by: Sequence[str], offset: str) -> DataFrame:
    # Joins further down imply these filters, but only on some branches of the
    # plan; stating them at the start keeps the branches alike, so Spark
    # shuffles each input once and reuses that exchange.
    return rows.where(" and ".join(f"{c} is not null" for c in (*by, offset)))


def _history(samples: DataFrame, by: Sequence[str], slice_bits: int) -> DataFrame:
    """One row per (key, offset) with its latest time, and its slice."""
    return (
        _named(samples, by, "off")
        .groupBy(*by, "off")
        .agg(F.max("at_ms").alias("at_ms"))
        .selectExpr(*by, f"shiftright(off, {slice_bits}) as slice", "off", "at_ms")
        .where("slice is not null")
    )


def _asked(points: DataFrame, by: Sequence[str], slice_bits: int) -> DataFrame:
    placed = _named(points, by, "c_off").selectExpr("*", f"shiftright(c_off, {slice_bits}) as slice")
    return placed.where("slice is not null")


def _over(by: Sequence[str], order: str = "", frame: str = "") -> str:
    return f"over (partition by {', '.join(by)} {'order by ' + order if order else ''} {frame})"


def _last_known(column: str, over: str) -> str:
    return f"last({column}) ignore nulls {over}"


def _next_known(column: str, over: str) -> str:
    # lead(...) ignore nulls keeps one moving pointer; a frame that ends at
    # unbounded following would be re-scanned for every row.
    return f"lead({column}) ignore nulls {over}"


def _slices(history: DataFrame, loads: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per asked slice: its ``copies``, the nearest samples outside it, and facts about the series.

    A series has one row per slice here, at most its greatest offset divided
    by the slice width.
    """
    sums = [
        "min(off) as first_off",
        "min_by(at_ms, off) as first_at",
        "max(off) as last_off",
        "max_by(at_ms, off) as last_at",
        "max(at_ms) as new_at",
        "max_by(off, at_ms) as new_off",
        "min(if(at_ms is null, off, null)) as spoilt_off",
    ]
    summary = history.groupBy(*by, "slice").agg(*[F.expr(e) for e in sums])
    series, ordered = _over(by), _over(by, "slice")
    earlier = _over(by, "slice", "rows between unbounded preceding and 1 preceding")
    return (
        summary.join(loads, [*by, "slice"], "full")
        .selectExpr(
            *by,
            "slice",
            "copies",
            f"{_last_known('last_off', earlier)} as prev_off",
            f"{_last_known('last_at', earlier)} as prev_at",
            f"{_next_known('first_off', ordered)} as next_off",
            f"{_next_known('first_at', ordered)} as next_at",
            f"min(first_off) {series} as min_off",
            f"max(last_off) {series} as max_off",
            f"min(spoilt_off) {series} as bad_off",
            f"max_by(new_off, new_at) {series} as leo",
            f"max(new_at) {series} as leo_at",
        )
        .where("copies is not null")
    )


def nearest_samples(
    points: DataFrame,
    samples: DataFrame,
    by: Sequence[str] = SERIES,
    slice_bits: int = SLICE_BITS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every row of ``points`` with the columns in ``NEIGHBOURS`` added.

    ``points`` has the key ``by``, the offset ``c_off`` and any other columns;
    rows without a key or offset are left out.  Neighbours are NULL where
    there is no such sample.
    """
    key = [*by, "slice"]
    others = [c for c in points.columns if c not in (*by, "c_off")]
    history = _history(samples, by, slice_bits)
    asked = _asked(points, by, slice_bits)
    counts = asked.groupBy(*key).agg(F.expr("count(*) as lookups"))
    # Fewer than MAX_HOT_SLICES slices can each hold this share of the lookups, which bounds the broadcast.
    share_of_all = counts.agg(F.expr(f"sum(lookups) div {MAX_HOT_SLICES}")).scalar()
    limit = F.greatest(F.lit(hot_rows), share_of_all)
    copies = F.when(F.col("lookups") > limit, F.lit(1) + F.call_function("div", F.col("lookups"), limit)).otherwise(1)
    loads = counts.select(*key, copies.cast("int").alias("copies"))
    hot = F.broadcast(loads.where("copies > 1"))

    share = f"cast(pmod(xxhash64({', '.join(['c_off', *others])}), coalesce(copies, 1)) as int)"
    lookup_rows = asked.join(hot, key, "left").selectExpr(
        *key, f"{share} as copy", "c_off as at_off", "true as is_lookup", *others
    )
    sample_rows = history.join(hot, key, "left").selectExpr(
        *key,
        "explode(sequence(0, coalesce(copies, 1) - 1)) as copy",
        "off as at_off",
        "false as is_lookup",
        "off as s_off",
        "at_ms",
    )
    # The leading edge sorts before everything in the slice (its offset lies in
    # an earlier slice, or is -1) and holds the facts; the trailing one sorts last.
    edges = f"""array_compact(array(
        struct(coalesce(prev_off, -1L) as at_off, prev_off as s_off, prev_at as at_ms, struct({', '.join(FACTS)}) as facts),
        if(next_off is null, null, struct(next_off as at_off, next_off as s_off, next_at as at_ms, null as facts))))"""
    edge_rows = (
        _slices(history, loads, by)
        .selectExpr(*key, "explode(sequence(0, copies - 1)) as copy", f"{edges} as edges")
        .selectExpr(*key, "copy", "false as is_lookup", "inline(edges)")
    )
    rows = lookup_rows.unionByName(sample_rows, allowMissingColumns=True).unionByName(
        edge_rows, allowMissingColumns=True
    )
    # A lookup of a sampled offset sorts after that sample.
    ordered = _over([*key, "copy"], "at_off, is_lookup")
    sofar = _over([*key, "copy"], "at_off, is_lookup", "rows between unbounded preceding and current row")
    found = rows.selectExpr(
        *by,
        *others,
        "at_off as c_off",
        "is_lookup",
        f"{_last_known('s_off', sofar)} as lo_off",
        f"{_last_known('at_ms', sofar)} as lo_at",
        f"{_next_known('s_off', ordered)} as up_off",
        f"{_next_known('at_ms', ordered)} as up_at",
        f"first(facts) {sofar} as facts",
    )
    return found.where("is_lookup").selectExpr(*points.columns, "lo_off", "lo_at", "up_off", "up_at", "facts.*")


def nearest_in_arrays(
    points: DataFrame,
    samples: DataFrame,
    by: Sequence[str] = SERIES,
    slice_bits: int = ARRAY_SLICE_BITS,
) -> DataFrame:
    """``nearest_samples`` with the samples of each slice folded into one array.

    Every lookup meets exactly one slice row, so nothing is sorted per lookup;
    a slice asked very often is split by Spark's skew join.  An array holds at
    most ``2**slice_bits`` entries, one per offset, so slices are kept narrow.
    Arrays join the slice rows only after the windows over a series.
    """
    key = [*by, "slice"]
    history = _history(samples, by, slice_bits)
    asked = _asked(points, by, slice_bits)
    loads = asked.select(*key, F.lit(1).alias("copies")).distinct()
    entries = history.groupBy(*key).agg(F.expr("array_sort(collect_list(struct(off, at_ms))) as entries"))
    slices = _slices(history, loads, by).join(entries, key, "left")
    return (
        asked.join(slices.hint("rebalance"), key)
        .selectExpr(
            "*",
            "try_element_at(filter(entries, e -> e.off <= c_off), -1) as below",
            "try_element_at(filter(entries, e -> e.off > c_off), 1) as above",
        )
        .selectExpr(
            *points.columns,
            "coalesce(below.off, prev_off) as lo_off",
            "if(below is null, prev_at, below.at_ms) as lo_at",
            "coalesce(above.off, next_off) as up_off",
            "if(above is null, next_at, above.at_ms) as up_at",
            *FACTS,
        )
    )
