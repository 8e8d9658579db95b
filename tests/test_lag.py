"""Time and offset lag: literal cases and random histories against a sequential walk."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from walk import walk_lag

from tidelag.operators import lag as L
from tidelag.operators.history import latest_offsets
from tidelag.operators.nearest import nearest_samples

S = "cluster string, topic string, part int, off bigint, at_ms bigint"
C = "cluster string, grp string, topic string, part int, c_off bigint"
BASE = 1724350000000

VARIANTS = {
    "slices": lambda c, s: L.partition_lag(c, s),
    "narrow slices": lambda c, s: L.partition_lag(c, s, slice_bits=2),
    "hot slices": lambda c, s: L.partition_lag(c, s, slice_bits=6, hot_rows=2),
    "distinct": lambda c, s: L.partition_lag_distinct(c, s, slice_bits=3),
    "arrays": lambda c, s: L.partition_lag_arrays(c, s, slice_bits=3),
}

# name, committed, history, expected (leo, lag_off, lag_s, case); the newest sample is the log end
CASES = [
    ("interpolated", 103, [(100, BASE), (105, BASE + 10000)], (105, 2, 4, "interp")),
    ("truncated", 100, [(99, BASE), (105, BASE + 10000)], (105, 5, 8, "interp")),
    ("one-point", 100, [(100, BASE)], (100, 0, None, "insufficient")),
    ("flat", 100, [(100, BASE), (100, BASE + 60000)], (100, 0, None, "insufficient")),
    ("caught-up", 110, [(100, BASE), (110, BASE + 10000)], (110, 0, 0, "exact")),
    ("past-end", 120, [(100, BASE), (110, BASE + 10000)], (110, 0, 0, "above")),
    ("before-start", 50, [(100, BASE), (105, BASE + 5000), (110, BASE + 10000)], (110, 60, 10, "below")),
    ("exact-old", 100, [(100, BASE), (105, BASE + 5000), (110, BASE + 9999)], (110, 10, 9, "exact")),
    ("no-history", 100, [], (None, None, None, None)),
    # the offset falls back after a truncation: the newest sample is the lower one
    ("regression", 150, [(200, BASE), (100, BASE + 8000)], (100, 0, 4, "interp")),
    ("minus-one", 100, [(100, BASE + 11000), (90, BASE + 11500), (120, BASE + 12900)], (120, 20, 1, "exact")),
]


def frames(spark, cases):
    samples = [("c", name, 0, off, at) for name, _, history, _ in cases for off, at in history]
    commits = [("c", "g", name, 0, c_off) for name, c_off, _, _ in cases]
    return spark.createDataFrame(commits, C), spark.createDataFrame(samples, S)


@pytest.mark.parametrize("variant", VARIANTS)
def test_literal_cases(spark, variant):
    commits, samples = frames(spark, CASES)
    got = {r[0]: tuple(r[1:]) for r in rows(VARIANTS[variant](commits, samples), "topic", "leo", "lag_off", "lag_s", "lag_s_case")}
    assert got == {name: expected for name, _, _, expected in CASES}


def test_negative_second_is_unknown(spark):
    # The reading below sits one whole second behind the newer of two samples.
    commits, samples = frames(spark, [("t", 10, [(10, BASE + 3000), (20, BASE + 1500)], None)])
    got = rows(L.partition_lag(commits, samples), "leo", "leo_at", "lag_s")
    assert got == [(10, BASE + 3000, 0)]
    located = spark.createDataFrame(
        [("c", "g", "t", 0, 10, 10, BASE + 1000, 20, BASE + 9000, 10, 20, None, 20, BASE),
         ("c", "g", "t", 1, 10, 10, BASE + 2000, 20, BASE + 9000, 10, 20, None, 20, BASE)],
        C + ", lo_off bigint, lo_at bigint, up_off bigint, up_at bigint, min_off bigint, max_off bigint,"
        " bad_off bigint, leo bigint, leo_at bigint",
    )
    assert rows(L.with_lag(located), "part", "lag_s") == [(0, None), (1, -2)]


def test_wide_gap_does_not_overflow(spark):
    far = 4 * 10**18
    commits, samples = frames(spark, [("t", far // 2, [(0, BASE), (far, BASE + 10000)], None)])
    assert rows(L.partition_lag(commits, samples), "lag_off", "lag_s") == [(far // 2, 5)]


def test_unreadable_time_counts_only_when_needed(spark):
    history = [(10, BASE), (20, BASE + 1000), (30, None), (40, BASE + 9000)]
    cases = [(str(c), c, history, None) for c in (10, 15, 25, 35, 50)]
    commits, samples = frames(spark, cases)
    got = dict(rows(L.partition_lag(commits, samples), "topic", "lag_s"))
    assert got == {str(c): walk_lag(history, c, BASE + 9000) for c in (10, 15, 25, 35, 50)}
    assert got["15"] == 8 and got["25"] is None and got["50"] is None


@pytest.mark.parametrize("variant", VARIANTS)
@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories_match_walk(spark, variant, seed):
    rng = random.Random(seed)
    samples, commits, expected = [], [], {}
    for series in range(60):
        n = rng.choice([0, 1, 2, 3, 8, 40])
        times = rng.sample(range(0, 500000), n)
        at = {t: rng.randrange(0, rng.choice([5, 60, 400])) for t in times}
        history = {}
        for t, off in at.items():
            samples.append(("c", f"t{series}", 0, off, BASE + t))
            history[off] = max(history.get(off, 0), BASE + t)
        newest = max(at, default=None)
        for g in range(rng.choice([1, 5])):
            c_off = rng.randrange(0, 420)
            commits.append(("c", f"g{g}", f"t{series}", 0, c_off))
            if newest is None:
                expected[(f"t{series}", f"g{g}")] = (None, None, None)
            else:
                leo = at[newest]
                lag = walk_lag(list(history.items()), c_off, BASE + newest)
                expected[(f"t{series}", f"g{g}")] = (leo, max(leo - c_off, 0), lag)
    lags = VARIANTS[variant](spark.createDataFrame(commits, C), spark.createDataFrame(samples, S))
    got = {(t, g): (a, b, c) for t, g, a, b, c in rows(lags, "topic", "grp", "leo", "lag_off", "lag_s")}
    assert got == expected


def test_one_hot_series_is_cut_into_bounded_sort_groups(spark):
    samples = spark.range(20000).select(
        F.lit("c").alias("cluster"), F.lit("hot").alias("topic"), F.lit(0).alias("part"),
        (F.col("id") * 3).alias("off"), (F.col("id") * 1000 + BASE).alias("at_ms"),
    )
    commits = spark.range(5000).select(
        F.lit("c").alias("cluster"), F.concat(F.lit("g"), F.col("id")).alias("grp"), F.lit("hot").alias("topic"),
        F.lit(0).alias("part"), F.when(F.col("id") % 2 == 0, 30001).otherwise(F.col("id") * 12 + 1).alias("c_off"),
    )
    lags = L.partition_lag(commits, samples, slice_bits=8, hot_rows=100)
    # offset 3k was produced at second k, so offset 3k+1 at k + 1/3
    check = lags.withColumn("want", F.expr("(19999000 - (c_off * 1000) div 3) div 1000"))
    assert check.count() == 5000
    assert check.where(F.abs(F.col("want") - F.col("lag_s")) > 1).count() == 0


def test_lookups_between_slices_reach_far_neighbours(spark):
    samples = spark.createDataFrame([("c", "t", 0, 0, BASE), ("c", "t", 0, 1 << 30, BASE + 1000)], S)
    points = spark.createDataFrame([("c", "t", 0, 1 << 20)], "cluster string, topic string, part int, c_off bigint")
    got = rows(nearest_samples(points, samples, slice_bits=10), "lo_off", "up_off", "min_off", "max_off")
    assert got == [(0, 1 << 30, 0, 1 << 30)]


def test_offset_lag_and_missing_offsets(spark):
    samples = spark.createDataFrame([("c", "t", 0, 110, BASE)], S)
    commits = spark.createDataFrame([("c", "g", "t", 0, 100), ("c", "h", "t", 0, 120), ("c", "g", "u", 0, 5), ("c", "k", "t", 0, -1), ("c", "k", "u", 0, -1)], C)
    latest = latest_offsets(samples)
    assert rows(L.offset_lag(commits.where("c_off >= 0"), latest), "grp", "lag_off") == [("g", 10), ("h", 0)]
    assert rows(L.missing_offsets(commits, latest), "grp", "topic", "skip_reason") == [
        ("g", "u", "log_end_unknown"),
        ("k", "t", "commit_unknown"),
        ("k", "u", "log_end_unknown commit_unknown"),
    ]


def test_valid_commits(spark):
    commits = spark.createDataFrame(
        [("c", "g", "t", 0, 5, 0), ("c", "g", "t", 1, -1, 0), ("c", "g", "t", 2, 5, 3), ("c", "g", "t", 3, 0, 0)],
        C + ", err_code int",
    )
    assert rows(L.valid_commits(commits), "part") == [(0,), (3,)]


# committed, log end, its time, history, lag in offsets and seconds
READ_NOW = [
    ("between", 100, 110, 1724360000000, [(99, 1724350000000), (105, 1724360000000)], 10, 8333),
    ("clamped", 110, 115, 1724365000000, [(100, 1724350000000), (105, 1724360000000)], 5, 5000),
    ("between-later", 103, 110, 1724365000000, [(100, 1724350000000), (105, 1724360000000)], 7, 9000),
    ("single", 100, 110, 1724360000000, [(100, 1724350000000)], 10, None),
    ("none", 100, 110, 1724360000000, [], 10, None),
]


def test_log_end_read_in_this_iteration(spark):
    commits, samples = frames(spark, [(n, c, h, None) for n, c, _, _, h, _, _ in READ_NOW] + [("unread", 1, [(5, BASE), (9, BASE + 1)], None)])
    latest = spark.createDataFrame(
        [("c", n, 0, leo, at) for n, _, leo, at, *_ in READ_NOW],
        "cluster string, topic string, part int, leo bigint, leo_at bigint",
    )
    got = {r[0]: r[1:] for r in rows(L.partition_lag(commits, samples, latest), "topic", "lag_off", "lag_s")}
    assert got.pop("unread") == (None, None)
    assert got == {n: (lag_off, lag_s) for n, *_, lag_off, lag_s in READ_NOW}
