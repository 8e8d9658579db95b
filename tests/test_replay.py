import random
import re

import pytest
from conftest import rows
from walk import walk_lag

from tidelag.operators import lag as L
from tidelag.operators.replay import in_eras, lag_replay, numbered_samples, replay_neighbours, window_ends, window_pieces
from tidelag.plans.iteration import iteration_lags

S = "cluster string, topic string, part int, off bigint, at_ms bigint"
C = "cluster string, grp string, topic string, part int, snapshot_ms bigint, c_off bigint"


def test_window_is_covered_exactly_once(spark):
    rng = random.Random(1)
    ttl, width = 13000, 13001
    log = {t * 977: rng.randrange(9) for t in range(60)}  # offsets fall at every second sample or so
    samples = spark.createDataFrame([("c", "t", 0, o, at) for at, o in log.items()], S)
    points = spark.createDataFrame([("c", "g", "t", 0, s * 1001, 0) for s in range(60)], C)
    ends = window_ends(points, samples, ttl)
    pieces = window_pieces(ends).selectExpr("snapshot_ms", "era", "f_at", "a_at", "inline(pieces)")
    covered = (
        pieces.join(numbered_samples(samples, width), ["era", "level", "node"])
        .where("(not holds_first or at_ms >= f_at) and (not holds_last or at_ms <= a_at)")
    )
    got = rows(covered, "snapshot_ms", "at_ms")
    want = [(s * 1001, at) for s in range(60) for at in log if s * 1001 - ttl <= at <= s * 1001]
    assert len(got) == len(set(got)) and set(got) == set(want)
    assert pieces.groupBy("snapshot_ms").count().agg({"count": "max"}).first()[0] <= 6  # of up to 14 samples


def test_a_log_that_never_falls_costs_few_rows(spark):
    """240 samples a window at uneven times: rows per sample and per commit, and no sort aggregate."""
    rng = random.Random(2)
    ttl = 7_200_000
    at, log = 0, []
    for i in range(720):
        at += 30_000 + rng.randrange(-9_999, 9_999)
        log.append(("c", "t", 0, i * 3, at))
    samples = spark.createDataFrame(log, S)
    commits = spark.createDataFrame([("c", f"g{i % 5}", "t", 0, at - i * 17_003, i) for i in range(300)], C)
    timed = in_eras(samples, ttl + 1).count()
    looked_up = numbered_samples(samples, ttl + 1).count()
    assert timed + looked_up <= 8 * 720
    pieces = window_pieces(window_ends(commits, samples, ttl)).selectExpr("inline(pieces)").count()
    assert 2 * 300 + pieces <= 8 * 300
    plan = lag_replay(commits, samples, 7200)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_one_hot_series_is_split_by_time_and_by_lookups(spark):
    samples = spark.createDataFrame([("c", "t", 0, i, i * 1000) for i in range(500)], S)
    commits = spark.createDataFrame([("c", f"g{i}", "t", 0, 5000 * (i % 100), i) for i in range(500)], C)
    per_era = numbered_samples(samples, 20001).groupBy("era").count().agg({"count": "max"}).first()[0]
    assert per_era <= 42
    columns = ("grp", "snapshot_ms", "leo", "lag_off", "lag_s", "lag_s_case")
    assert rows(lag_replay(commits, samples, 20, hot_rows=3), *columns) == rows(lag_replay(commits, samples, 20), *columns)


@pytest.mark.parametrize("step", [1, 250])
def test_every_snapshot_matches_the_walk(spark, step):
    rng = random.Random(step)
    ttl = 5
    samples, commits, expected = [], [], {}
    for series in range(25):
        falls = series % 3  # never, at times, at every other sample
        # a truncated log starts again lower
        off, log = 0, {}
        for _ in range(rng.choice([0, 1, 5, 60])):
            at = rng.randrange(0, 20000) // step * step
            log[at] = None
        for at in sorted(log):
            off = max(0, off + (rng.choice([0, 0, 1, 7]) if rng.random() < (1, 0.9, 0.5)[falls] else -9))
            log[at] = off
            samples.append(("c", f"t{series}", 0, off, at))
        for _ in range(12):
            key = (f"t{series}", f"g{rng.randrange(3)}", rng.randrange(0, 20000) // step * step)
            if key in expected:
                continue
            c_off = rng.randrange(0, 60)
            commits.append(("c", key[1], key[0], 0, key[2], c_off))
            seen = {a: o for a, o in log.items() if key[2] - ttl * 1000 <= a <= key[2]}
            if not seen:
                expected[key] = (None, None, None)
                continue
            latest = {}
            for a, o in seen.items():
                latest[o] = max(latest.get(o, 0), a)
            newest = max(seen)
            expected[key] = (seen[newest], max(seen[newest] - c_off, 0), walk_lag(list(latest.items()), c_off, newest))
    lags = lag_replay(spark.createDataFrame(commits, C), spark.createDataFrame(samples, S), ttl)
    got = {(t, g, s): (a, b, c) for t, g, s, a, b, c in rows(lags, "topic", "grp", "snapshot_ms", "leo", "lag_off", "lag_s")}
    assert got == expected


def test_single_snapshot_equals_partition_lag(spark):
    samples = spark.createDataFrame([("c", "t", 0, i * i, i * 1000) for i in range(20)], S)
    commits = spark.createDataFrame([("c", f"g{i}", "t", 0, 19000, i * 17) for i in range(20)], C)
    replayed = lag_replay(commits, samples, 3600)
    assert rows(replayed, "grp", "lag_off", "lag_s", "lag_s_case") == rows(L.partition_lag(commits, samples), "grp", "lag_off", "lag_s", "lag_s_case")


def dealt_by(df):
    """Keys of all shuffles in the plan of ``df``, without the number of partitions."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    return {tuple(re.sub(r"#\d+L?", "", k).split(", ")) for k in found}


COUNTED = {("bucket",), ("cluster", "topic", "part", "era")}
COPY = ("cluster", "topic", "part", "era", "copy")


def test_commits_and_samples_cross_the_network_once(spark):
    samples = spark.createDataFrame([("c", "t", 0, i, i * 1000) for i in range(9)], S)
    commits = spark.createDataFrame([("c", "g", "t", 0, 8000, 3)], C)
    assert dealt_by(lag_replay(commits, samples, 20)) == COUNTED | {COPY}


def test_few_samples_go_to_two_eras(spark):
    """Eras of four windows: a sample in the last quarter of one is seen from the next as well."""
    samples = spark.createDataFrame([("c", "t", 0, i, i * 1000) for i in range(400)], S)
    dealt = rows(in_eras(samples, 10_000, 4), "era", "at_ms")
    assert len(dealt) == 500
    assert set(dealt) == {(at // 40_000 + k, at) for at in range(0, 400_000, 1000) for k in (0, 1) if k == 0 or at % 40_000 >= 30_000}


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_log_ends_are_the_newest_read(spark, hot_rows):
    rng = random.Random(7)
    history = [("c", f"t{i % 3}", 0, rng.randrange(50), i * 700) for i in range(60)]
    read = [("c", f"t{i % 3}", 0, None if i % 7 == 0 else i, rng.randrange(9), 1000 * rng.randrange(40)) for i in range(200)]
    commits = sorted({("c", f"g{i % 4}", f"t{rng.randrange(4)}", 0, 1000 * rng.randrange(45), rng.randrange(60)) for i in range(150)})
    newest = {}
    for _, topic, _, off, at, snapshot in read:
        newest.setdefault((topic, snapshot), {}).setdefault(at, set()).add(off)
    once = [(c, t, p, off, at, s) for c, t, p, off, at, s in read if len(newest[t, s][at]) == 1]  # unique per series and time
    newest = {}
    for _, topic, _, off, at, snapshot in once:
        newest[topic, snapshot] = max(newest.get((topic, snapshot), (-1, None)), (at, off), key=lambda r: r[0])
    found = replay_neighbours(
        spark.createDataFrame(commits, C), spark.createDataFrame(history, S), 9000, hot_rows=hot_rows,
        read=spark.createDataFrame(once, S + ", snapshot_ms bigint"),
    )
    got = rows(found, "grp", "topic", "snapshot_ms", "c_off", "leo_at", "leo")
    want = [(g, t, s, c, *newest.get((t, s), (None, None))) for _, g, t, _, s, c in commits]
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert any(r[5] is not None for r in got) and any(r[4] is None for r in got)
    kept = ("grp", "topic", "snapshot_ms", "c_off", "lo_off", "lo_at", "up_off", "up_at", "min_off", "max_off")
    assert rows(found, *kept) == rows(replay_neighbours(spark.createDataFrame(commits, C), spark.createDataFrame(history, S), 9000), *kept)


def test_log_ends_have_no_shuffle_of_their_own(spark):
    samples = spark.createDataFrame([("c", "t", 0, i, i * 1000) for i in range(9)], S)
    commits = spark.createDataFrame([("c", "g", "t", 0, 8000, 3)], C).selectExpr("*", "0 as err_code")
    lags = iteration_lags(commits, commits, samples, samples, commits, 20)
    assert rows(lags, "leo", "leo_at", "lag_off") == [(8, 8000, 5)]
    keys = dealt_by(lags)
    assert COPY in keys and not any("part" in k and "snapshot_ms" in k for k in keys)
