import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidelag.functions import gauge_text, merge_labels
from tidelag.operators import gauges as G
from tidelag.operators.rollup import all_levels

L = "cluster string, grp string, topic string, part int, lag_off bigint, lag_s bigint"


def published(spark, *facts, extra=None):
    frame = spark.createDataFrame([("c1", "g", *f) for f in facts], L)
    return G.lag_gauges(all_levels(frame), extra)


def as_dict(gauges):
    return {(r.name, tuple(sorted(r.labels.items()))): r.value for r in gauges.collect()}


def test_all_ten_gauges_and_their_labels(spark):
    got = as_dict(published(spark, ("t", 0, 10, 100), ("t", 1, 50, 500)))
    group, topic = (("clustername", "c1"), ("group", "g")), (("clustername", "c1"), ("group", "g"), ("topic", "t"))
    part = lambda p: (("clustername", "c1"), ("group", "g"), ("partition", p), ("topic", "t"))
    prefix = "kafka_consumer_group_"
    assert got == {
        (prefix + "lag_in_offsets", part("0")): 10, (prefix + "lag_in_offsets", part("1")): 50,
        (prefix + "lag_in_seconds", part("0")): 100, (prefix + "lag_in_seconds", part("1")): 500,
        (prefix + "topic_max_lag_in_offsets", topic): 50, (prefix + "topic_max_lag_in_seconds", topic): 500,
        (prefix + "topic_sum_lag_in_offsets", topic): 60, (prefix + "topic_sum_lag_in_seconds", topic): 600,
        (prefix + "max_lag_in_offsets", group): 50, (prefix + "max_lag_in_seconds", group): 500,
        (prefix + "sum_lag_in_offsets", group): 60, (prefix + "sum_lag_in_seconds", group): 600,
    }


def test_unknown_and_minus_one_are_not_published(spark):
    names = {n for n, _ in as_dict(published(spark, ("t", 0, 10, None)))}
    assert names and all(n.endswith("offsets") for n in names)
    # seconds of -3 and 2 add up to -1, which readers take for unknown
    got = as_dict(published(spark, ("t", 0, 0, -3), ("t", 1, 0, 2)))
    assert not any("sum_lag_in_seconds" in n for n, _ in got)
    assert any("sum_lag_in_offsets" in n for n, _ in got)


def test_zero_is_published(spark):
    got = as_dict(published(spark, ("t", 0, 0, 0)))
    assert len(got) == 10 and set(got.values()) == {0.0}


def test_extra_labels_win(spark):
    got = as_dict(published(spark, ("t", 0, 1, 1), extra={"env": "prod", "group": "x"}))
    assert all(("env", "prod") in labels and ("group", "x") in labels for _, labels in got)


def test_later_map_wins(spark):
    maps = [F.expr(f"map({m})").cast("map<string,string>") for m in ("'a','1','b','1'", "'b','2','c','2'", "'c','3'")]
    assert spark.range(1).select(merge_labels(*maps)).first()[0] == {"a": "1", "b": "2", "c": "3"}


def test_checked_and_iteration_gauges(spark):
    checked = spark.createDataFrame([("c1", 2)], "cluster string, groups_checked bigint")
    assert as_dict(G.checked_gauges(checked, {"env": "x"})) == {("kafka_total_groups_checked", (("clustername", "c1"), ("env", "x"))): 2}
    assert as_dict(G.iteration_gauge(spark.sql("select 0.125D seconds"))) == {("kafka_iteration_time_seconds", ()): 0.125}


def test_iteration_times(spark):
    log = spark.createDataFrame([(1, 1000), (1, 1100), (2, 5000)], "iteration bigint, at_ms bigint")
    assert rows(G.iteration_times(log)) == [(1, 100), (2, 0)]


def test_last_values_are_sticky(spark):
    log = spark.createDataFrame(
        [("m", {"a": "1"}, 5.0, 1), ("m", {"a": "1"}, 7.0, 2), ("m", {"a": "2"}, 9.0, 1)],
        "name string, labels map<string,string>, value double, at_ms bigint",
    )
    assert rows(G.last_values(log), "value", "at_ms") == [(7.0, 2), (9.0, 1)]


# Expected texts: shortest digits, exponent form below 1e-4 and from 1e6 up.
TEXTS = {
    0.0: "0", 1.0: "1", -3.0: "-3", 999999.0: "999999", 1e6: "1e+06", 1234567.0: "1.234567e+06", 12345678.0: "1.2345678e+07",
    -2500000.0: "-2.5e+06", 0.125: "0.125", 0.0005: "0.0005", 0.00012: "0.00012", 1.5e-5: "1.5e-05", 1e21: "1e+21",
    2e100: "2e+100", float("inf"): "+Inf", float("-inf"): "-Inf", float("nan"): "NaN", 1234567.25: "1.23456725e+06",
}


@pytest.mark.parametrize("value", TEXTS)
def test_gauge_text(spark, value):
    frame = spark.createDataFrame([(value,)], "v double")
    assert frame.select(gauge_text(F.col("v"))).first()[0] == TEXTS[value]


def test_exposition_page(spark, tmp_path):
    gauges = spark.createDataFrame(
        [("kafka_total_groups_checked", {"clustername": 'a"b\\c\nd'}, 2.0), ("kafka_iteration_time_seconds", {}, 0.5)],
        "name string, labels map<string,string>, value double",
    )
    lines = G.exposition(gauges)
    page = [r.line for r in lines.orderBy("name", "seq", "labels").collect()]
    assert page == [
        "# HELP kafka_iteration_time_seconds The time taken to complete an iteration of checking all consumer groups.",
        "# TYPE kafka_iteration_time_seconds gauge",
        "kafka_iteration_time_seconds 0.5",
        "# HELP kafka_total_groups_checked The total number of consumer groups checked in each iteration.",
        "# TYPE kafka_total_groups_checked gauge",
        'kafka_total_groups_checked{clustername="a\\"b\\\\c\\nd"} 2',
    ]
    G.write_exposition(lines, str(tmp_path / "page"))
    assert [r.value for r in spark.read.text(str(tmp_path / "page")).collect()] == page


def test_timeseries(spark):
    gauges = spark.createDataFrame([("m", {"b": "2", "a": "1"}, 3.0, 1999)], "name string, labels map<string,string>, value double, at_ms bigint")
    got = G.timeseries(gauges).first()
    assert [tuple(x) for x in got.labels] == [("__name__", "m"), ("a", "1"), ("b", "2")]
    assert (got.value, got.timestamp_ms) == (3.0, 1000)
