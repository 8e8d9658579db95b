import functools
import os
import time
import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidelag.model import COMMITS, SAMPLES
from tidelag.operators import history as H
from tidelag.operators.gauges import last_values
from tidelag.streaming.gauge_table import GaugeTable
from tidelag.operators.members import sessions
from tidelag.plans.iteration import published_gauges
from tidelag.sources.tables import stream_table
from tidelag.streaming.history_log import HistoryLog
from tidelag.streaming.lag_stream import (
    IterationTimes,
    LagIteration,
    session_stream,
    start_lag_stream,
    tagged_inputs,
)

GROUPS = "cluster string, grp string, error string, snapshot_ms bigint"
TTL = 3600
STEP = 600000  # ten minutes


def iteration_inputs(spark, i):
    """What iteration i reads: two series, three groups, one of them without commits."""
    at = (i + 1) * STEP
    samples = [("c", "t", p, 100 * i + 10 * p, at) for p in (0, 1)]
    commits = [("c", f"g{g}", "t", p, 60 * i + g, 0, at) for g in (0, 1) for p in (0, 1)] + [("c", "idle", "t", 0, -1, 0, at)]
    groups = [("c", g, None, at) for g in ("g0", "g1", "idle", "hidden")]
    return (
        spark.createDataFrame(groups, GROUPS),
        spark.createDataFrame(commits, COMMITS),
        spark.createDataFrame(samples, SAMPLES),
    )


def config(spark):
    clusters = spark.createDataFrame([("c", True, True, None)], "cluster string, has_client boolean, has_config boolean, list_error string")
    rules = spark.createDataFrame([("c", None, "hidden")], "cluster string, whitelist string, blacklist string")
    return clusters, rules


def test_history_log_equals_one_merge(spark, tmp_path):
    log = HistoryLog(spark, str(tmp_path / "h"), ttl_seconds=60)
    everything = []
    for batch in range(6):
        new = [("c", "t", 0, batch // 2, batch * 20000), ("c", "u", 0, batch, batch * 20000 + 5)]
        everything += new
        for _ in range(2 if batch == 3 else 1):  # a repeated batch changes nothing
            log.append(spark.createDataFrame(new, SAMPLES), batch)
    now = 5 * 20000 + 5
    want = H.retain(H.unique_times(spark.createDataFrame(everything, SAMPLES)), 60, now)
    assert rows(log.read(now)) == rows(want)
    assert log.expire(now) == 0 or rows(log.read(now)) == rows(want)


def test_history_log_expires_by_the_age_of_writing_only(spark, tmp_path):
    log = HistoryLog(spark, str(tmp_path / "h"), ttl_seconds=10)
    for batch in range(12):
        log.append(spark.createDataFrame([("c", "t", 0, batch, batch * 10000)], SAMPLES), batch)
    assert log.expire() == 0
    assert rows(log.read(110000)) == [("c", "t", 0, 10, 100000), ("c", "t", 0, 11, 110000)]
    assert log.expire(int(time.time() * 1000) + 3 * 3_600_000) in (1, 2)


def test_history_log_is_lossless(spark, tmp_path):
    path = str(tmp_path / "h")
    near = [("c", "t", 0, n, n * 1000) for n in range(3)]
    one, two = HistoryLog(spark, path, 7200, "one"), HistoryLog(spark, path, 7200, "two")
    one.append(spark.createDataFrame(near, SAMPLES), 0)
    # a second stream with the same batch number, whose clock is three hours ahead
    two.append(spark.createDataFrame([("d", "t", 0, 9, 3 * 3_600_000)], SAMPLES), 0)
    one.expire()
    assert rows(one.read(2000)) == near
    assert HistoryLog(spark, path, 3600).read(2000).count() == 3  # another retention, the same files
    assert len(rows(two.read(3 * 3_600_000))) == 1


def test_series_without_new_samples_is_kept_for_one_retention(spark, tmp_path):
    log = HistoryLog(spark, str(tmp_path / "h"), ttl_seconds=10)
    log.append(spark.createDataFrame([("c", "t", 0, 1, 1000), ("c", "t", 0, 2, 10000)], SAMPLES), 0)
    assert len(rows(log.read(20000))) == 2
    assert rows(log.read(20001)) == []


def told_runs(spark, path, wanted):
    """(batch, duration_ms) of the run log, once the listener has told of ``wanted`` batches."""
    for _ in range(120):
        if os.path.isdir(path):
            found = rows(spark.read.parquet(path), "batch", "duration_ms")
            if len(found) == wanted and found[-1][0] == wanted - 1:
                time.sleep(5)  # the gauge follows the log
                return found
        time.sleep(0.5)
    raise AssertionError("no run log")


def test_lag_stream_equals_batch(spark, tmp_path):
    dirs = {k: str(tmp_path / k) for k in ("groups", "commits", "samples")}
    frames = [iteration_inputs(spark, i) for i in range(4)]
    clusters, rules = config(spark)
    log = HistoryLog(spark, str(tmp_path / "history"), TTL)
    sticky = GaugeTable(spark, str(tmp_path / "sticky"), "lag", fold_every=3)
    iteration = LagIteration(log, str(tmp_path / "gauges"), clusters, rules, {"env": "t"}, sticky=sticky)
    listener = IterationTimes(iteration, str(tmp_path / "runs"), "lag")
    spark.streams.addListener(listener)
    for n, parts in enumerate(frames):
        for df, kind in zip(parts, ("groups", "commits", "samples")):
            df.coalesce(1).write.mode("append").parquet(dirs[kind])
        inputs = tagged_inputs(
            stream_table(spark, dirs["groups"], spark.createDataFrame([], GROUPS).schema),
            stream_table(spark, dirs["commits"], COMMITS),
            stream_table(spark, dirs["samples"], SAMPLES),
        )
        query = start_lag_stream(inputs, iteration, "lag", str(tmp_path / "checkpoint"), interval=None)
        assert query.awaitTermination(120)
    runs = told_runs(spark, str(tmp_path / "runs"), 4)
    spark.streams.removeListener(listener)
    gauges = spark.read.parquet(str(tmp_path / "gauges"))
    assert gauges.select("batch").distinct().count() == 4
    flat = lambda df: rows(df.select("name", F.array_sort(F.map_entries("labels")).cast("string"), "value"))
    groups, commits, samples = frames[3]
    history = H.retain(spark.createDataFrame([r for f in frames for r in f[2].collect()], SAMPLES), TTL)
    want = published_gauges(groups, clusters, rules, commits, history, {"env": "t"}, H.latest_offsets(samples))
    got = gauges.where("batch = 3 and part = 'lag'")
    assert flat(got) == flat(want)
    checked = got.where("name = 'kafka_total_groups_checked'").first()
    assert checked.value == 3.0 and checked.labels == {"clustername": "c", "env": "t"}
    assert gauges.where("part = 'iteration' and value >= 0").count() == 4
    # the published duration is that of the whole batch, sources and planning included
    seconds = gauges.where("part = 'iteration'").select("batch", "value", "at_ms")
    assert rows(seconds) == [(b, ms / 1000, (b + 1) * STEP) for b, ms in runs]
    all_lag = gauges.where("part = 'lag'").select("name", "labels", "value", "at_ms")
    assert flat(sticky.read()) == flat(last_values(all_lag)) and len(sticky._deltas()) < 3
    # repeating a micro-batch replaces its output instead of adding to it
    before = gauges.count()
    batch = tagged_inputs(*frames[3])
    iteration(batch, 3)
    again = spark.read.parquet(str(tmp_path / "gauges"))
    assert again.count() == before and flat(again.where("batch = 3 and part = 'lag'")) == flat(want)


def flat_gauges(df):
    return rows(df.select("name", F.array_sort(F.map_entries("labels")).cast("string"), "value", "at_ms"))


def published(spark, folder, batches, clusters, rules, ttl=TTL):
    """All lag gauges of an iteration object that is given ``batches`` of (groups, commits, samples) one by one."""
    iteration = LagIteration(HistoryLog(spark, f"{folder}/h", ttl), f"{folder}/g", clusters, rules)
    for i, parts in enumerate(batches):
        iteration(tagged_inputs(*parts), i)
    return spark.read.parquet(f"{folder}/g").where("part = 'lag'")


def joined(frames):
    return [functools.reduce(lambda a, b: a.unionByName(b), [f[k] for f in frames]) for k in range(3)]


def test_backlog_publishes_every_iteration(spark, tmp_path):
    """Four iterations in one batch, from which groups, positions and reads vanish in between, equal four batches."""
    clusters, rules = config(spark)
    frames = [list(iteration_inputs(spark, i)) for i in range(4)]
    frames[1][0] = frames[1][0].where("grp <> 'g1'")  # not listed
    frames[1][1] = frames[1][1].where("grp <> 'g1'")
    frames[2][0] = frames[2][0].withColumn("error", F.when(F.col("grp") == "g0", "timeout"))
    frames[2][1] = frames[2][1].where("part = 0")  # a position is gone
    frames[3][2] = frames[3][2].where("part = 0")  # a series could not be read
    apart = flat_gauges(published(spark, tmp_path / "a", frames, clusters, rules))
    together = flat_gauges(published(spark, tmp_path / "b", [joined(frames)], clusters, rules))
    assert together == apart
    assert {r[3] for r in apart} == {STEP, 2 * STEP, 3 * STEP, 4 * STEP}


def test_old_failure_does_not_hide_a_group_that_is_well_now(spark, tmp_path):
    clusters, rules = config(spark)
    groups = spark.createDataFrame([("c", "g", "timeout", 1000), ("c", "g", None, 2000)], GROUPS)
    commits = spark.createDataFrame([("c", "g", "t", 0, 50, 0, 2000)], COMMITS)
    samples = spark.createDataFrame([("c", "t", 0, 90, 1000), ("c", "t", 0, 100, 2000)], SAMPLES)
    out = published(spark, tmp_path, [(groups, commits, samples)], clusters, rules)
    lag = out.where("name = 'kafka_consumer_group_lag_in_offsets'")
    assert rows(lag, "value", "at_ms") == [(50.0, 2000)]


def test_vanished_positions_and_groups_do_not_count(spark, tmp_path):
    clusters, rules = config(spark)
    groups = spark.createDataFrame([("c", "g", None, 1000), ("c", "gone", None, 1000), ("c", "g", None, 2000)], GROUPS)
    commits = spark.createDataFrame([("c", "g", "t", 0, 0, 0, 1000), ("c", "g", "t", 1, 90, 0, 2000)], COMMITS)
    samples = spark.createDataFrame([("c", "t", p, 100, at) for p in (0, 1) for at in (1000, 2000)], SAMPLES)
    out = published(spark, tmp_path, [(groups, commits, samples)], clusters, rules).where("at_ms = 2000")
    assert rows(out.where("name = 'kafka_consumer_group_sum_lag_in_offsets'"), "value") == [(10.0,)]
    assert rows(out.where("name = 'kafka_total_groups_checked'"), "value") == [(1.0,)]


def test_a_cluster_three_hours_ahead_changes_nothing_elsewhere(spark, tmp_path):
    clusters = spark.createDataFrame([(c, True, True, None) for c in "cd"], "cluster string, has_client boolean, has_config boolean, list_error string")
    rules = spark.createDataFrame([(c, None, None) for c in "cd"], "cluster string, whitelist string, blacklist string")
    ahead = 3 * 3_600_000

    def inputs(names):
        shift = {"c": 0, "d": ahead}
        return (
            spark.createDataFrame([(c, "g", None, shift[c] + 60_000) for c in names], GROUPS),
            spark.createDataFrame([(c, "g", "t", 0, 50, 0, shift[c] + 60_000) for c in names], COMMITS),
            spark.createDataFrame([(c, "t", 0, o, shift[c] + at) for c in names for o, at in ((0, 0), (100, 60_000))], SAMPLES),
        )

    both = published(spark, tmp_path / "two", [inputs("cd")], clusters, rules)
    alone = published(spark, tmp_path / "one", [inputs("c")], clusters, rules)
    mine = both.where("labels['clustername'] = 'c'")
    assert flat_gauges(mine) == flat_gauges(alone)
    seconds = mine.where("name = 'kafka_consumer_group_lag_in_seconds'")
    assert rows(seconds, "value", "at_ms") == [(30.0, 60_000)]
    assert both.where("labels['clustername'] = 'd' and name = 'kafka_consumer_group_lag_in_seconds'").first().at_ms == ahead + 60_000


def test_history_by_the_clock_of_each_cluster(spark, tmp_path):
    log = HistoryLog(spark, str(tmp_path / "h"), ttl_seconds=10)
    ahead = 3 * 3_600_000
    mine, theirs = [("c", "t", 0, n, n * 1000) for n in range(3)], [("d", "t", 0, n, ahead + n * 1000) for n in range(3)]
    log.append(spark.createDataFrame(mine + theirs + [("e", "t", 0, 1, 1000)], SAMPLES), 0)
    clocks = spark.createDataFrame([("c", 1500), ("d", ahead + 2000)], "cluster string, now_ms bigint")
    assert rows(log.read(clocks)) == sorted(mine[:2] + theirs, key=lambda r: tuple((x is None, str(x)) for x in r))
    late = spark.createDataFrame([("c", 12_001), ("d", ahead + 2000)], "cluster string, now_ms bigint")
    assert rows(log.read(late)) == theirs


def test_groups_without_commits_are_counted(spark, tmp_path):
    clusters, rules = config(spark)
    groups, commits, samples = iteration_inputs(spark, 0)
    iteration = LagIteration(HistoryLog(spark, str(tmp_path / "h"), TTL), str(tmp_path / "g"), clusters, rules)
    iteration(tagged_inputs(groups, commits.limit(0), samples.limit(0)), 0)
    checked = spark.read.parquet(str(tmp_path / "g")).where("name = 'kafka_total_groups_checked'").first()
    assert checked.value >= 1


def test_checkpoint_folder_comes_from_the_session(spark, tmp_path):
    clusters, rules = config(spark)
    iteration = LagIteration(HistoryLog(spark, str(tmp_path / "h"), TTL), str(tmp_path / "gauges"), clusters, rules)
    for df, kind in zip(iteration_inputs(spark, 0), ("groups", "commits", "samples")):
        df.coalesce(1).write.parquet(str(tmp_path / kind))
    inputs = tagged_inputs(
        stream_table(spark, str(tmp_path / "groups"), spark.createDataFrame([], GROUPS).schema),
        stream_table(spark, str(tmp_path / "commits"), COMMITS),
        stream_table(spark, str(tmp_path / "samples"), SAMPLES),
    )
    name = f"lag-{uuid.uuid4()}"
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        with pytest.raises(ValueError):
            start_lag_stream(inputs, iteration, name, interval=None)
    else:
        assert start_lag_stream(inputs, iteration, name, interval=None).awaitTermination(120)
        assert os.path.isdir(os.path.join(shared.removeprefix("file:"), name))


def test_unread_series_gets_no_lag_in_that_iteration(spark, tmp_path):
    clusters, rules = config(spark)
    log = HistoryLog(spark, str(tmp_path / "history"), TTL)
    iteration = LagIteration(log, str(tmp_path / "gauges"), clusters, rules)
    for i in range(3):
        groups, commits, samples = iteration_inputs(spark, i)
        iteration(tagged_inputs(groups, commits, samples.where("part = 0") if i == 2 else samples), i)
    lag = spark.read.parquet(str(tmp_path / "gauges")).where("name = 'kafka_consumer_group_lag_in_offsets'")
    per_batch = rows(lag.groupBy("batch", F.col("labels")["partition"].alias("p")).count())
    assert per_batch == [(0, "0", 2), (0, "1", 2), (1, "0", 2), (1, "1", 2), (2, "0", 2)]


def test_session_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "b")
    beats = spark.createDataFrame([("a", 1000), ("a", 5000), ("a", 30000), ("b", 2000), ("z", 500000)], "member string, at_ms bigint")
    beats.withColumn("ts", F.timestamp_millis("at_ms")).coalesce(1).write.parquet(src)
    stream = session_stream(spark.readStream.schema("member string, at_ms bigint, ts timestamp").parquet(src), "10 seconds", "1 second")
    query = (
        stream.writeStream.outputMode("append").format("memory").queryName("closed_sessions")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    want = [r for r in rows(sessions(beats, 10000), "member", "start_ms", "end_ms", "beats") if r[0] != "z"]
    assert rows(spark.table("closed_sessions"), "member", "start_ms", "end_ms", "beats") == want
