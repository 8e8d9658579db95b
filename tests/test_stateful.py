"""Keyed state, the gauge table, closed hours of the history and inputs of single clusters."""

import os
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidelag.model import METRICS, SAMPLES
from tidelag.operators import groups as GR
from tidelag.operators import history as H
from tidelag.operators.gauges import last_values
from tidelag.operators.members import member_index
from tidelag.sources.clusters import read_clusters
from tidelag.streaming.gauge_table import GaugeTable
from tidelag.streaming.history_log import HOUR_MS, HistoryLog
from tidelag.streaming.stateful import folded_history, history_stream, live_after, member_stream, use_rocksdb

EVENTS = "member string, kind string, at_ms bigint"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class Feed:
    """Batches put one by one into a stream whose changes are kept as a table."""

    def __init__(self, spark, folder, schema, build):
        self.spark, self.schema = spark, schema
        self.source, self.out = f"{folder}/in", f"{folder}/out"
        self.sent = 0
        os.makedirs(self.source)
        stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(self.source))
        self.query = (
            stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/cp")
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{self.out}/batch={n}"))
            .trigger(processingTime="200 milliseconds").start()
        )

    def put(self, *records):
        # Timers keep such a stream running batches without data, so it is never idle: wait for the rows instead.
        self.spark.createDataFrame(records, self.schema).coalesce(1).write.mode("append").parquet(self.source)
        self.sent += len(records)
        end = time.time() + 60
        while sum({p.batchId: p.numInputRows for p in self.query.recentProgress}.values()) < self.sent:
            assert self.query.isActive and time.time() < end, self.query.exception()
            time.sleep(0.2)

    def changes(self):
        return self.spark.read.parquet(self.out).drop("batch")

    def until(self, true, seconds=60):
        end = time.time() + seconds
        while not true(self.changes()):
            assert time.time() < end, rows(self.changes())
            time.sleep(0.5)


def test_history_in_state_equals_the_merged_batch_and_silent_series_go(spark, tmp_path, rocksdb):
    ttl = 12
    batches = [
        [("c", "t", 0, 5, 1000), ("c", "t", 0, 6, 4000), ("d", "t", 0, 1, 10**9), ("c", "u", 1, 3, 500)],
        [("c", "t", 0, 7, 15000), ("c", "t", 0, 9, 4000), ("c", "t", 0, 2, 1500), ("c", "t", 0, None, 1), ("d", "t", 0, 1, 10**9)],
        [("c", "t", 0, 8, 16000), ("c", "t", 0, 8, 3999), ("c", "t", 0, 8, 4001)],
    ]
    feed = Feed(spark, tmp_path, SAMPLES, lambda s: history_stream(s, ttl, silence_seconds=25))
    try:
        for batch in batches:
            feed.put(*batch)
        everything = spark.createDataFrame([r for b in batches for r in b], SAMPLES)
        want = rows(H.retain(H.unique_times(everything), ttl))
        assert rows(folded_history(feed.changes())) == want
        # series ("c", "t") goes on, the others are silent and go by themselves, whatever their clocks say
        end = time.time() + 60
        at = 17000
        while {r[:3] for r in rows(folded_history(feed.changes()))} != {("c", "t", 0)}:
            assert time.time() < end
            feed.put(("c", "t", 0, 9, at))
            at += 1
            time.sleep(1)
    finally:
        feed.query.stop()


def test_members_join_fall_silent_leave_and_come_back(spark, tmp_path, rocksdb):
    feed = Feed(spark, tmp_path, EVENTS, lambda s: member_stream(s, 15))
    last = lambda df, m: [r[1] for r in sorted(rows(df.where(F.col("member") == m), "seq", "event"))]
    try:
        feed.put(("a", "beat", 1000), ("b", "beat", 2000), ("c", "beat", 10**12), ("nobody", "leave", 5))
        assert rows(live_after(feed.changes())) == [("a", 1000), ("b", 2000), ("c", 10**12)]
        feed.put(("b", "leave", 3000), ("a", "beat", 3000))
        assert rows(member_index(live_after(feed.changes())), "member", "member_index", "members") == [("a", 0, 2), ("c", 1, 2)]
        feed.put(("b", "beat", 4000), ("b", "leave", 1))  # joins anew; a leave from before that has no effect
        assert rows(live_after(feed.changes())) == [("a", 1000), ("b", 4000), ("c", 10**12)]
        # all fall silent and are evicted without any new row
        feed.until(lambda df: rows(live_after(df)) == [])
        assert last(feed.changes(), "a") == ["joined", "evicted"]
        assert last(feed.changes(), "b") == ["joined", "left", "joined", "evicted"]
        assert last(feed.changes(), "nobody") == []
        feed.put(("a", "beat", 90000))
        assert rows(live_after(feed.changes())) == [("a", 90000)]
    finally:
        feed.query.stop()


def test_gauge_table_stays_small_and_equals_the_fold_of_all(spark, tmp_path):
    table = GaugeTable(spark, str(tmp_path / "t"), fold_every=5)
    assert rows(table.read(), "value") == []
    everything = []
    for b in range(22):
        new = [("m", {"a": str(b % 3)}, float(b), b), ("n", {}, 1.0 * b, b % 4)]
        everything += new
        table.add(spark.createDataFrame(new, METRICS), b)
    flat = lambda df: rows(df.select("name", F.array_sort(F.map_entries("labels")).cast("string"), "value", "at_ms"))
    all_of = spark.createDataFrame(everything, METRICS)
    # of equal times any may be kept, as in the batch form; here the times of "n" repeat
    got, want = flat(table.read().where("name = 'm'")), flat(last_values(all_of.where("name = 'm'")))
    assert got == want and flat(table.read().where("name = 'n'"))[0][3] == 3
    assert len(table._deltas()) < 5 and len(os.listdir(tmp_path / "t/main/base")) <= 2
    assert len(table.read().inputFiles()) < 5 * 8 + 8


def test_gauge_table_survives_a_stop_while_folding(spark, tmp_path):
    table = GaugeTable(spark, str(tmp_path / "t"), fold_every=100)
    for b in range(3):
        table.add(spark.createDataFrame([("m", {}, float(b), b)], METRICS), b)
    base = tmp_path / "t/main/base/0"
    table._rows(None, table._deltas()).write.parquet(str(base / "rows"))  # stopped before its names were written
    assert rows(table.read(), "value", "at_ms") == [(2.0, 2)]
    spark.createDataFrame([("0",), ("1",), ("2",)], "delta string").write.parquet(str(base / "held"))  # before removal
    assert rows(table.read(), "value", "at_ms") == [(2.0, 2)]
    table.add(spark.createDataFrame([("m", {}, 9.0, 9)], METRICS), 3)
    table.fold()
    assert rows(table.read(), "value", "at_ms") == [(9.0, 9)] and table._deltas() == []


def parquet_files(folder):
    return [f for _, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]


def test_closing_an_hour_bounds_its_files_and_survives_a_stop(spark, tmp_path):
    log = HistoryLog(spark, str(tmp_path / "h"), ttl_seconds=3600)
    everything = []
    for b in range(20):
        new = [("c", f"t{i}", 0, b, b * 60_000 + i) for i in range(4)]
        everything += new
        log.append(spark.createDataFrame(new, SAMPLES), b)
    now = 20 * 60_000
    want = rows(H.retain(H.unique_times(spark.createDataFrame(everything, SAMPLES)), 3600, now))
    assert len(parquet_files(tmp_path / "h/open")) >= 20
    assert log.close() == 0 and rows(log.read(now)) == want  # the hour is not over
    later = int(time.time() * 1000) + HOUR_MS
    # a stop after the new files were written leaves both: nothing counts twice
    hour = log._hours(log.open)[0]
    spark.read.schema(f"{SAMPLES.toDDL()}, bucket bigint").parquet(f"{log.open}/written={hour}").write.partitionBy("bucket").parquet(
        f"{log.closed}/written={hour}/version=1"
    )
    assert rows(log.read(now)) == want
    # and one half-way through writing leaves a folder without its mark, which is passed over
    os.makedirs(tmp_path / f"h/closed/written={hour}/version=7")
    assert rows(log.read(now)) == want
    assert log.close(later) in (1, 2)
    assert parquet_files(tmp_path / "h/open") == [] and len(parquet_files(tmp_path / "h/closed")) <= 4
    assert rows(log.read(now)) == want
    log.append(spark.createDataFrame([("c", "t0", 0, 99, now)], SAMPLES), 20)
    log.close(later + HOUR_MS)
    assert len(rows(log.read(now))) == len(want) + 1
    assert log.expire(later + 4 * HOUR_MS) >= 1 and rows(log.read(now)) == []


def test_a_new_checkpoint_under_the_old_name_replaces_nothing(spark, tmp_path):
    log = HistoryLog(spark, str(tmp_path / "h"), 3600, "lag")
    for run, off in (("one", 1), ("two", 2)):
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", run)
        log.append(spark.createDataFrame([("c", "t", 0, off, off * 1000)], SAMPLES), 0)
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
    assert rows(log.read(2000)) == [("c", "t", 0, 1, 1000), ("c", "t", 0, 2, 2000)]


def test_one_unreadable_cluster_costs_only_itself(spark, tmp_path):
    schema = spark.createDataFrame([], "cluster string, grp string, error string").schema
    paths = {c: str(tmp_path / c) for c in ("good", "bad", "other", "absent")}
    for c in ("good", "bad", "other"):
        spark.createDataFrame([(f"{c}-{i}", None) for i in range(3)], "grp string, error string").coalesce(1).write.parquet(paths[c])
    damaged = next(p for p in (tmp_path / "bad").iterdir() if p.suffix == ".parquet")
    damaged.write_bytes(b"PAR1 this is no table PAR1")
    (tmp_path / "bad" / f".{damaged.name}.crc").unlink(missing_ok=True)
    listed, clusters = read_clusters(spark, paths, schema, str(tmp_path / "copy"))
    assert rows(listed, "cluster", "grp") == [(c, f"{c}-{i}") for c in ("good", "other") for i in range(3)]
    failed = rows(clusters.where("list_error is not null"), "cluster")
    assert failed == [("absent",), ("bad",)]
    assert len(rows(GR.good_groups(listed, clusters))) == 6
    known = listed.unionByName(spark.createDataFrame([("bad", "bad-0", None)], schema))
    errors = GR.group_errors(known, clusters)
    assert rows(errors, "cluster", "scope") == [("bad", "cluster")] and errors.first().reason.startswith("unreadable input")
