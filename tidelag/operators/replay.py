"""Lag at every past snapshot, each against the history its iteration would have read.

A snapshot at time t sees the samples with ``t - ttl <= at <= seen``.  Joining each commit to all of them would
emit every pair in the window.  Instead use is made of offsets that rarely fall:

1. Samples and commits are dealt to (series, era), an era being as wide as ERA_WINDOWS windows, so a window lies in an
   era and the last window's width of the one before it; samples in that last width go to two eras.  An era asked very
   often gets several copies, each with all its samples and a share of its commits.  This is the only shuffle: all that
   follows is done inside an era.
2. In time order every fall of the offset begins a new *run*, and each commit finds the first and last sample of its
   window and their runs.  Inside a run, what the window sees is one stretch of offsets, so those two samples are
   enough to cut the answer of a lookup that knows the run alone.
3. Samples fold to one row per run and offset.  One sort by offset inside (series, era, run) finds the samples around
   every commit.  A log that never falls has one run, hence one lookup per commit.  Where a window spans several runs,
   the whole ones between its ends are covered by nodes of a binary hierarchy over the run numbers, and the few partial
   answers are folded together.

In the lookup a sample has one row a level of the hierarchy, whose height is the logarithm of the runs in its era: none
for a log that never falls.  Times may be of any resolution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.model import HOT_ROWS, MAX_HOT_SLICES, SERIES
from tidelag.operators.lag import with_lag

ERA = [*SERIES, "era"]
COPY = [*ERA, "copy"]
NODE = [*ERA, "level", "node"]
ENDS = ["f_off", "f_at", "f_run", "a_off", "a_at", "a_run"]

# An era is so many windows wide: the wider, the fewer samples go to two eras, and the more one task holds.
ERA_WINDOWS = 4

# Hash buckets by which eras are counted, a power of two; more than MAX_HOT_SLICES, so that few are as full as a hot era.
ERA_BUCKETS = 16_384

# Offset first, then age, in one number that hash aggregation can keep: ages are far below 10**18 ms.
_AGES = "1000000000000000000BD"


def _floor_div(value: str, by: int) -> str:
    return f"(({value}) - pmod({value}, {by}L)) div {by}L"


def _known(*columns: str) -> str:
    return " and ".join(f"{c} is not null" for c in dict.fromkeys(columns))


def in_eras(samples: DataFrame, width: int, windows: int = 1) -> DataFrame:
    """Every sample in its own era of ``windows * width``, and in the next if windows of ``width`` reach back to it."""
    era = windows * width
    known = samples.where("off is not null and at_ms is not null").selectExpr(*SERIES, "off", "at_ms")
    own = _floor_div("at_ms", era)
    reached = f"pmod(at_ms, {era}L) >= {era - width}L"
    return known.selectExpr(*SERIES, f"explode(if({reached}, array({own}, {own} + 1), array({own}))) as era", "off", "at_ms")


def _in_order(rows: DataFrame, by: list[str] = ERA, told: tuple[str, ...] = (), then: str = "") -> DataFrame:
    """``rows`` (era, at, kind, off, at_ms) with the samples before and after each and its ``run``; off is NULL on marks.

    The last known values of the columns ``told`` are added; rows alike in time and kind are ordered by ``then``.
    """
    by_time = f"partition by {', '.join(by)} order by at, kind{then}"
    order = f"over ({by_time})"
    so_far = f"over ({by_time} rows between unbounded preceding and current row)"
    seen = rows.selectExpr(
        "*",
        f"lag(off) ignore nulls {order} as before_off",
        f"last(off) ignore nulls {so_far} as last_off",
        f"last(at_ms) ignore nulls {so_far} as last_at",
        f"lead(off) ignore nulls {order} as next_off",
        f"lead(at_ms) ignore nulls {order} as next_at",
        *[f"last({c}) ignore nulls {so_far} as last_{c}" for c in told],
    )
    runs = seen.selectExpr("*", f"sum(if(off < before_off, 1L, 0L)) {so_far} as run")
    return runs.selectExpr("*", f"max(run) over (partition by {', '.join(by)}) as last_run")


# A level is of use only where one of its nodes fits between two runs of the era.
_LEVELS = "sequence(0, if(last_run < 2, 0, cast(floor(log2(last_run - 1)) as int)))"

# Ends of a window from its two marks: kind 0 sorts before a sample of the same time, kind 2 after it.
_ENDS_OF_MARKS = [
    "max(if(kind = 0, next_off, null)) as f_off",
    "max(if(kind = 0, next_at, null)) as f_at",
    "max(if(kind = 0, run + if(next_off < last_off, 1L, 0L), null)) as f_run",
    "max(if(kind = 2, last_off, null)) as a_off",
    "max(if(kind = 2, last_at, null)) as a_at",
    "max(if(kind = 2, run, null)) as a_run",
]


def _marks(ttl_ms: int, seen: str) -> str:
    return f"array(struct(snapshot_ms - {ttl_ms}L as at, 0 as kind), struct({seen} as at, 2 as kind))"


def numbered_samples(samples: DataFrame, width: int) -> DataFrame:
    """Samples keyed by era and node: level 0 is their run, higher levels hold 2, 4, ... whole runs each."""
    rows = in_eras(samples, width).selectExpr(*ERA, "at_ms as at", "1 as kind", "off", "at_ms")
    runs = _in_order(rows).selectExpr(*ERA, "off", "at_ms", "run", f"explode({_LEVELS}) as level")
    return runs.selectExpr(*ERA, "level", "shiftright(run, level) as node", "off", "at_ms")


def window_ends(commit_log: DataFrame, samples: DataFrame, ttl_ms: int, ahead_ms: int = 0, seen: str = "snapshot_ms") -> DataFrame:
    """Per distinct (series, snapshot): first (f) and last (a) sample of its window and their runs; NULL if it is empty.

    A window reaches from ``ttl_ms`` before the snapshot to the time in column ``seen``, at most ``ahead_ms`` after it.
    """
    width = ttl_ms + ahead_ms + 1
    window = [*SERIES, "snapshot_ms", *({seen} - {"snapshot_ms"})]
    windows = commit_log.select(*window).distinct().selectExpr("*", f"{_floor_div(seen, width)} as era")
    rows = in_eras(samples, width).selectExpr(*ERA, "at_ms as at", "1 as kind", "off", "at_ms")
    marks = windows.selectExpr(*ERA, *window[3:], f"inline({_marks(ttl_ms, seen)})")
    placed = _in_order(rows.unionByName(marks, allowMissingColumns=True)).where("kind <> 1")
    # Both marks of a window lie in one era, so this needs no further shuffle.
    ends = placed.groupBy(*ERA, *window[3:]).agg(*[F.expr(e) for e in _ENDS_OF_MARKS])
    return ends.selectExpr(*ERA, *window[3:], *[f"if(f_at <= a_at, {c}, null) as {c}" for c in ENDS])


def _pieces(levels: int = 40) -> str:
    """SQL for the nodes that cover a window: the runs of its two ends, and whole runs between them.

    At level k the part of [f_run + 1, a_run) not covered by finer nodes is [first, stop), the ends rounded inwards to
    multiples of 2**k; an odd end cannot move up a level.  An empty window gets a node that holds no sample.
    """
    piece = "struct({} as level, {} as node, {} as holds_first, {} as holds_last)".format
    first = "shiftright(f_run + shiftleft(1L, k), k)"
    stop = "shiftright(a_run, k)"
    inner = f"""flatten(transform(sequence(0, cast(floor(log2(greatest(a_run - f_run, 1L))) as int)), k -> array_compact(array(
        if({first} < {stop} and {first} % 2 = 1, {piece('k', first, 'false', 'false')}, null),
        if({first} < {stop} and {stop} % 2 = 1, {piece('k', f'{stop} - 1', 'false', 'false')}, null)))))"""
    ends = f"array({piece('0', 'f_run', 'true', 'false')}, {piece('0', 'a_run', 'false', 'true')})"
    return f"""case when f_run is null then array({piece('-1', '-1L', 'false', 'false')})
        when f_run = a_run then array({piece('0', 'f_run', 'true', 'true')})
        else concat({ends}, if(a_run - f_run > 1, {inner}, array())) end"""


def window_pieces(ends: DataFrame) -> DataFrame:
    """The ends of every window and the nodes that cover it."""
    return ends.selectExpr("*", f"{_pieces()} as pieces")


def _hot_eras(lookups: DataFrame, hot_rows: int) -> DataFrame:
    """Eras asked more than ``hot_rows`` times and the copies they get.

    Fewer than MAX_HOT_SLICES eras, or buckets of eras, can each hold more than their part of all lookups, which bounds
    the broadcasts.  Eras are counted only in the buckets that hold enough lookups for a hot one, since counting all
    would shuffle about as many rows as there are lookups.
    """
    asked = lookups.selectExpr(*ERA, f"xxhash64({', '.join(ERA)}) & {ERA_BUCKETS - 1}L as bucket")
    buckets = asked.groupBy("bucket").agg(F.count("*").alias("lookups"))
    share_of_all = buckets.agg(F.expr(f"sum(lookups) div {MAX_HOT_SLICES}")).scalar()
    limit = F.greatest(F.lit(hot_rows), share_of_all)
    full = F.broadcast(buckets.where(F.col("lookups") > limit).select("bucket"))
    counts = asked.join(full, "bucket", "left_semi").groupBy(*ERA).agg(F.count("*").alias("lookups"))
    copies = (F.lit(1) + F.call_function("div", F.col("lookups"), limit)).cast("int")
    return F.broadcast(counts.where(F.col("lookups") > limit).select(*ERA, copies.alias("copies")))


def _dealt(lookups: DataFrame, samples: DataFrame, read: DataFrame | None, hot: DataFrame) -> DataFrame:
    """Lookups (``c_off``, others), samples (``off``, ``at_ms``) and reads (``r_off``, ``r_at``) of every era together, by copy."""
    others = [c for c in lookups.columns if c not in ERA]
    share = f"cast(pmod(xxhash64({', '.join(others)}), coalesce(copies, 1)) as int) as copy"
    every = "explode(sequence(0, coalesce(copies, 1) - 1)) as copy"
    rows = lookups.join(hot, ERA, "left").selectExpr(*ERA, share, *others)
    rows = rows.unionByName(samples.join(hot, ERA, "left").selectExpr(*ERA, every, "off", "at_ms"), allowMissingColumns=True)
    if read is not None:
        rest = [c for c in read.columns if c not in ERA]
        rows = rows.unionByName(read.join(hot, ERA, "left").selectExpr(*ERA, every, *rest), allowMissingColumns=True)
    return rows.repartition(*COPY)


def _in_time(rows: DataFrame, ttl_ms: int, seen: str) -> DataFrame:
    """Lookups with the ends of their windows, and samples folded to one row per run and offset with the latest time."""
    others = [c for c in rows.columns if c not in (*COPY, "off", "at_ms", "r_off", "r_at")]
    at = "array(struct({} as at, 1 as kind))".format
    marks = f"case when c_off is not null then {_marks(ttl_ms, seen)} when off is not null then {at('at_ms')} else {at(seen)} end"
    timed = rows.selectExpr("*", f"inline({marks})")
    if "r_at" in rows.columns:
        # What was read stands at the end of its window, the newest last.
        timed = timed.withColumn("read", F.expr("if(r_at is null, null, struct(r_at, r_off, snapshot_ms))")).drop("r_at", "r_off")
        placed = _in_order(timed, COPY, ("read",), ", read").where("c_off is not null or off is not null")
        own = "if(kind = 2 and last_read.snapshot_ms = snapshot_ms, last_read.{}, null)".format
        log_end = [f"max({own('r_off')}) as leo", f"max({own('r_at')}) as leo_at"]
    else:
        placed = _in_order(timed, COPY)
        log_end = []
    placed = placed.withColumn("s_run", F.expr("if(kind = 1, run, null)"))
    folded = placed.groupBy(*COPY, *others, "off", "s_run").agg(
        F.max("at_ms").alias("s_at"),
        F.max("last_run").alias("last_run"),
        *[F.expr(e) for e in (*_ENDS_OF_MARKS, *log_end)],
    )
    ends = folded.selectExpr(
        *COPY,
        *others,
        *[c for c in folded.columns if c in ("leo", "leo_at")],
        "off as s_off",
        "s_at",
        "s_run",
        "last_run",
        *[f"if(f_at <= a_at, {c}, null) as {c}" for c in ENDS],
    )
    return ends if log_end else ends.withColumns({"leo": F.col("a_off"), "leo_at": F.col("a_at")})


def _in_nodes(rows: DataFrame) -> DataFrame:
    """Lookups in all nodes that cover their window, samples in the nodes of all levels."""
    levels = f"""transform({_LEVELS}, k -> struct(
        k as level, shiftright(s_run, k) as node, false as holds_first, false as holds_last))"""
    nodes = f"inline(if(s_off is null, {_pieces()}, {levels}))"
    placed = rows.withColumnRenamed("c_off", "own_off").selectExpr("*", nodes).drop("s_run", "last_run")
    asked = "if(holds_first and own_off < f_off, f_off, own_off)"
    return placed.selectExpr("*", "s_off is null as is_lookup", f"coalesce(s_off, {asked}) as at_off")


def _around(rows: DataFrame) -> DataFrame:
    """Lookups with the samples around ``at_off`` in their node, and the node's range of offsets."""
    of_node = [*NODE, "copy"]
    node = f"partition by {', '.join(of_node)}"
    order = f"{node} order by at_off, is_lookup"  # a lookup of a sampled offset sorts after that sample
    so_far = f"over ({order} rows between unbounded preceding and current row)"
    # Runs in one node may share an offset; its latest time counts.  The one sort serves both windows.
    rows = rows.sortWithinPartitions(*of_node, "at_off", "is_lookup")
    latest = rows.withColumn("s_at", F.expr(f"if(is_lookup, null, max(s_at) over ({node}, at_off))"))
    found = latest.selectExpr(
        *[c for c in rows.columns if c not in ("s_off", "s_at")],
        f"last(s_off) ignore nulls {so_far} as lo_off",
        f"last(s_at) ignore nulls {so_far} as lo_at",
        f"lead(s_off) ignore nulls over ({order}) as up_off",
        f"lead(s_at) ignore nulls over ({order}) as up_at",
        f"min(s_off) over ({node}) as min_off",
        f"max(s_off) over ({node}) as max_off",
    )
    return found.where("is_lookup").drop("is_lookup", "at_off")


def _cut(found: DataFrame) -> DataFrame:
    """Cut what a whole run answers to what the window sees of it."""
    # Below the first sample in sight the lookup asked for that sample itself: it is the upper neighbour.
    below = found.selectExpr(
        "*",
        "holds_first and own_off < f_off as under",
        "holds_last and lo_off >= a_off as over",
    )
    inside = below.selectExpr(
        "*",
        "if(under, lo_off, up_off) as u_off",
        "if(under, lo_at, up_at) as u_at",
    )
    # The last sample in sight may not be the last of its offset, nor of the run.
    return inside.selectExpr(
        "*",
        "case when under then null when over then a_off else lo_off end as cut_lo_off",
        "case when under then null when over then a_at else lo_at end as cut_lo_at",
        "if(over and not under, null, u_off) as cut_up_off",
        "if(holds_last and u_off = a_off, a_at, u_at) as cut_up_at",
        "if(holds_first, f_off, min_off) as least_off",
        "if(holds_last, a_off, max_off) as most_off",
    )


def replay_neighbours(
    commit_log: DataFrame,
    samples: DataFrame,
    ttl_ms: int,
    ahead_ms: int = 0,
    hot_rows: int = HOT_ROWS,
    seen: str = "snapshot_ms",
    read: DataFrame | None = None,
) -> DataFrame:
    """Every commit with the samples around its offset in the window of its snapshot (see ``nearest.NEIGHBOURS``).

    A window ends at the time in column ``seen``, at most ``ahead_ms`` after the snapshot.  Its newest sample is the log
    end, unless ``read`` has the samples that each snapshot read itself, with the columns ``snapshot_ms`` and ``seen``;
    then it is the newest of those, and unknown without any.
    """
    position = list(commit_log.columns)
    width = ttl_ms + ahead_ms + 1
    own = f"{_floor_div(seen, ERA_WINDOWS * width)} as era"
    # Joins further down imply some of these filters on some branches; stated here, all reads of the commits share one shuffle.
    lookups = commit_log.selectExpr("*", own).where(_known(*ERA, "c_off", "snapshot_ms", seen))
    if read is not None:
        kept = dict.fromkeys(["snapshot_ms", seen])
        read = read.selectExpr(*SERIES, own, *kept, "off as r_off", "at_ms as r_at").where(_known(*ERA, *kept, "r_at"))
    hot = _hot_eras(lookups, hot_rows)
    rows = _dealt(lookups, in_eras(samples, width, ERA_WINDOWS), read, hot)
    cut = _cut(_around(_in_nodes(_in_time(rows, ttl_ms, seen))))
    age = f"({seen} - {{}})".format
    folded = (
        cut.withColumnRenamed("own_off", "c_off")
        .groupBy(*COPY, *[c for c in position if c not in SERIES])
        .agg(
            F.expr(f"max(cast(cut_lo_off as decimal(19,0)) * {_AGES} + ({_AGES} - 1BD - {age('cut_lo_at')})) as lo"),
            F.expr(f"min(cast(cut_up_off as decimal(19,0)) * {_AGES} + {age('cut_up_at')}) as up"),
            F.min("least_off").alias("min_off"),
            F.max("most_off").alias("max_off"),
            F.max("leo").alias("leo"),
            F.max("leo_at").alias("leo_at"),
        )
    )
    offset = f"cast(({{0}} - pmod({{0}}, {_AGES})) / {_AGES} as bigint)".format
    return folded.selectExpr(
        *position,
        f"{offset('lo')} as lo_off",
        f"cast({seen} - ({_AGES} - 1BD - pmod(lo, {_AGES})) as bigint) as lo_at",
        f"{offset('up')} as up_off",
        f"cast({seen} - pmod(up, {_AGES}) as bigint) as up_at",
        "min_off",
        "max_off",
        "cast(null as bigint) as bad_off",
        "leo",
        "leo_at",
    )


def lag_replay(
    commit_log: DataFrame,
    samples: DataFrame,
    ttl_seconds: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``partition_lag`` for every ``snapshot_ms`` of the commit log, which has at most one commit per position and snapshot."""
    return with_lag(replay_neighbours(commit_log, samples, ttl_seconds * 1000, 0, hot_rows))
