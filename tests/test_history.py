from conftest import rows

from tidelag.operators import history as H
from tidelag.sources.kafka import as_messages

S = "cluster string, topic string, part int, off bigint, at_ms bigint"


def samples(spark, *points, topic="t", cluster="c"):
    return spark.createDataFrame([(cluster, topic, 0, o, a) for o, a in points], S)


def test_compress_keeps_latest_time(spark):
    raw = samples(spark, (100, 1609459200000), (100, 1609459205000), (101, 1609459260000), (101, 1609459265000))
    assert rows(H.compress(raw), "off", "at_ms") == [(100, 1609459205000), (101, 1609459265000)]
    plain = samples(spark, (100, 1609459200000), (101, 1609459260000))
    assert rows(H.compress(plain), "off", "at_ms") == [(100, 1609459200000), (101, 1609459260000)]


def test_clusters_are_separate_series(spark):
    both = samples(spark, (100, 1), (101, 2)).unionByName(samples(spark, (200, 1), (201, 2), cluster="d"))
    assert rows(H.latest_offsets(both), "cluster", "leo", "leo_at") == [("c", 101, 2), ("d", 201, 2)]


def test_retention_is_strict_and_from_the_newest(spark):
    now = 1_000_000
    raw = samples(spark, (100, now - 120000), (200, now - 60000), (300, now), (250, now - 30000))
    assert rows(H.retain(raw, 30), "off") == [(250,), (300,)]


def test_retention_forgets_expired_series(spark):
    raw = samples(spark, (1, 1000), (2, 5000)).unionByName(samples(spark, (1, 90000), topic="u"))
    assert rows(H.retain(raw, 30, now_ms=36000), "topic", "off") == [("u", 1)]
    assert rows(H.retain(raw, 30, now_ms=35000), "topic", "off") == [("t", 1), ("t", 2), ("u", 1)]


def test_flat_run_keeps_both_ends(spark):
    raw = samples(spark, (7, 1), (7, 2), (7, 3), (8, 4), (9, 5), (9, 6))
    assert rows(H.compact_flat_runs(raw), "off", "at_ms") == [(7, 1), (7, 3), (8, 4), (9, 5), (9, 6)]


def test_compaction_does_not_change_compression(spark):
    raw = samples(spark, (7, 1), (7, 2), (7, 3), (8, 4), (9, 5), (9, 6))
    assert rows(H.compress(H.compact_flat_runs(raw))) == rows(H.compress(raw))


def test_same_time_keeps_the_later_offset(spark):
    raw = samples(spark, (5, 1), (6, 1), (6, 2))
    assert rows(H.unique_times(raw), "off", "at_ms") == [(6, 1), (6, 2)]


def test_merge_is_idempotent_and_ignores_unknown(spark):
    old, new = samples(spark, (5, 1), (6, 2)), samples(spark, (7, 3), (None, 4), (8, None))
    once = H.merge_samples(old, new)
    assert rows(once, "off", "at_ms") == [(5, 1), (6, 2), (7, 3)]
    assert rows(H.merge_samples(once, new)) == rows(once)


def test_text_times(spark):
    raw = spark.createDataFrame(
        [("c", "t", 0, 5, "1000"), ("c", "t", 0, 5, "2000"), ("c", "t", 0, 6, "3000"), ("c", "t", 0, 6, "bad"), ("c", "t", 0, 7, "4000")],
        "cluster string, topic string, part int, off bigint, member string",
    )
    assert rows(H.compress_text(raw), "off", "at_ms") == [(5, 2000), (6, None), (7, 4000)]


def test_valid_samples(spark):
    raw = spark.createDataFrame(
        [("c", "t", 0, 1, 0, [5, 4]), ("c", "t", 1, 1, 6, [5]), ("c", "t", 2, 1, 0, []), ("c", "t", 3, 1, 0, None)],
        "cluster string, topic string, part int, at_ms bigint, err_code int, offsets array<bigint>",
    )
    assert rows(H.valid_samples(raw), "part", "off") == [(0, 5)]


def test_log_end_is_the_next_offset(spark):
    raw = spark.createDataFrame(
        [("c", "t", 0, 41, 10), ("c", "t", 0, 42, 9)], "cluster string, topic string, part int, offset bigint, at_ms bigint"
    )
    assert rows(H.log_end_from_messages(raw), "leo", "leo_at") == [(43, 10)]


def test_tail(spark):
    raw = samples(spark, (7, 1), (7, 2), (8, 3), (6, 9))
    assert rows(H.series_tail(raw), "rank", "off", "at_ms") == [(1, 8, 3), (2, 7, 2)]


def test_rows_of_the_kafka_source(spark):
    raw = spark.sql(
        "select * from values ('t', 0, 7L, timestamp_millis(1500)), ('t', 0, 8L, timestamp_millis(2500)), ('t', 1, 0L, timestamp_millis(10))"
        " as m(topic, partition, offset, timestamp)"
    )
    got = H.log_end_from_messages(as_messages(raw, "c1"))
    assert rows(got) == [("c1", "t", 0, 9, 2500), ("c1", "t", 1, 1, 10)]
