"""Labelled gauges: building, last values, text lines and series rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelag.functions import gauge_text, label_text, merge_labels

# Names and help texts of the published gauges.
HELP = {
    "kafka_consumer_group_lag_in_offsets": "The lag in offsets for a Kafka consumer group.",
    "kafka_consumer_group_lag_in_seconds": "The lag in seconds for a Kafka consumer group.",
    "kafka_consumer_group_max_lag_in_offsets": "The maximum lag in offsets for a Kafka consumer group.",
    "kafka_consumer_group_max_lag_in_seconds": "The maximum lag in seconds for a Kafka consumer group.",
    "kafka_consumer_group_topic_max_lag_in_offsets": "The maximum lag in offsets for a Kafka topic.",
    "kafka_consumer_group_topic_max_lag_in_seconds": "The maximum lag in seconds for a Kafka topic.",
    "kafka_consumer_group_sum_lag_in_offsets": "The sum of lag in offsets for a Kafka consumer group.",
    "kafka_consumer_group_sum_lag_in_seconds": "The sum of lag in seconds for a Kafka consumer group.",
    "kafka_consumer_group_topic_sum_lag_in_offsets": "The sum of lag in offsets for a Kafka topic.",
    "kafka_consumer_group_topic_sum_lag_in_seconds": "The sum of lag in seconds for a Kafka topic.",
    "kafka_total_groups_checked": "The total number of consumer groups checked in each iteration.",
    "kafka_iteration_time_seconds": "The time taken to complete an iteration of checking all consumer groups.",
}

_PREFIX = "kafka_consumer_group_"

# Per level: gauge stem and the rollup column it shows.
_LEVEL_GAUGES = {
    "partition": {"lag_in_offsets": "max_off", "lag_in_seconds": "max_s"},
    "topic": {
        "topic_max_lag_in_offsets": "max_off",
        "topic_max_lag_in_seconds": "max_s",
        "topic_sum_lag_in_offsets": "sum_off",
        "topic_sum_lag_in_seconds": "sum_s",
    },
    "group": {
        "max_lag_in_offsets": "max_off",
        "max_lag_in_seconds": "max_s",
        "sum_lag_in_offsets": "sum_off",
        "sum_lag_in_seconds": "sum_s",
    },
}


def _label_map(values: Mapping[str, Column | str]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    pairs = [x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]
    return F.create_map(*pairs)


def _carried(rows: DataFrame) -> list[str]:
    """Columns that tell which iteration a row belongs to."""
    return [c for c in rows.columns if c in ("at_ms", "snapshot_ms")]


def _publishable(gauges: DataFrame) -> DataFrame:
    # Unknown values are not published, nor is a sum that happens to be -1,
    # which readers of these gauges take for unknown.
    return gauges.where("value is not null and value <> -1")


def lag_gauges(levels: DataFrame, extra: Mapping[str, str] | None = None) -> DataFrame:
    """The ten lag gauges from the rows of ``rollup.all_levels``: name, labels, value."""
    gauges = F.when(F.lit(False), F.lit(None))
    for level, names in _LEVEL_GAUGES.items():
        rows = F.array(
            *[
                F.struct(F.lit(_PREFIX + name).alias("name"), F.col(column).cast("double").alias("value"))
                for name, column in names.items()
            ]
        )
        gauges = gauges.when(F.col("level") == level, rows)
    all_labels = _label_map(
        {
            "clustername": F.col("cluster"),
            "group": F.col("grp"),
            "topic": F.col("topic"),
            "partition": F.col("part").cast("string"),
        }
    )
    labels = F.map_filter(all_labels, lambda _, v: v.isNotNull())
    if extra:
        labels = merge_labels(labels, _label_map(extra))
    carried = _carried(levels)
    return _publishable(
        levels.select(*carried, labels.alias("labels"), F.explode(gauges).alias("g")).select(
            F.col("g.name").alias("name"), "labels", F.col("g.value").alias("value"), *carried
        )
    )


def checked_gauges(checked: DataFrame, extra: Mapping[str, str] | None = None) -> DataFrame:
    """``kafka_total_groups_checked`` per cluster."""
    labels = merge_labels(_label_map({"clustername": F.col("cluster")}), _label_map(extra or {}))
    return checked.select(
        F.lit("kafka_total_groups_checked").alias("name"),
        labels.alias("labels"),
        F.col("groups_checked").cast("double").alias("value"),
        *_carried(checked),
    )


def iteration_gauge(seconds: DataFrame) -> DataFrame:
    """``kafka_iteration_time_seconds`` from a one-column table; it carries no labels."""
    return seconds.select(
        F.lit("kafka_iteration_time_seconds").alias("name"),
        _label_map({}).alias("labels"),
        F.col("seconds").cast("double").alias("value"),
    )


def iteration_times(run_log: DataFrame) -> DataFrame:
    """Milliseconds between the first and the last stage record of each iteration, as a whole number."""
    return run_log.groupBy("iteration").agg((F.max("at_ms") - F.min("at_ms")).cast("bigint").alias("span_ms"))


def last_values(gauges: DataFrame) -> DataFrame:
    """Last published value per name and label set; gauges are never withdrawn."""
    return gauges.groupBy("name", "labels").agg(
        F.max_by("value", "at_ms").alias("value"), F.max("at_ms").alias("at_ms")
    )


def exposition(gauges: DataFrame) -> DataFrame:
    """Text lines with their sort key: ``orderBy(name, seq, labels)`` gives the page.

    Every metric that has a sample gets a HELP line (seq 0) and a TYPE line (seq 1).
    """
    text = label_text(F.col("labels"))
    braced = F.when(text == "", "").otherwise(F.concat(F.lit("{"), text, F.lit("}")))
    samples = gauges.select(
        "name",
        F.lit(2).alias("seq"),
        text.alias("labels"),
        F.concat("name", braced, F.lit(" "), gauge_text(F.col("value"))).alias("line"),
    )
    helps = _label_map(HELP)
    header = F.array(
        F.struct(F.lit(0).alias("seq"), F.concat(F.lit("# HELP "), "name", F.lit(" "), helps[F.col("name")]).alias("line")),
        F.struct(F.lit(1).alias("seq"), F.concat(F.lit("# TYPE "), "name", F.lit(" gauge")).alias("line")),
    )
    headers = (
        gauges.select("name")
        .distinct()
        .select("name", F.explode(header).alias("h"))
        .where("h.line is not null")  # a metric without a known description has no HELP line
        .select("name", F.col("h.seq").alias("seq"), F.lit("").alias("labels"), F.col("h.line").alias("line"))
    )
    return headers.unionByName(samples)


def write_exposition(lines: DataFrame, path: str) -> None:
    """Write the page as ordered text files."""
    lines.orderBy("name", "seq", "labels").select("line").write.mode("overwrite").text(path)


def timeseries(gauges: DataFrame) -> DataFrame:
    """Series rows: labels led by ``__name__``, value and time cut to whole seconds."""
    named = F.array(F.struct(F.lit("__name__").alias("name"), F.col("name").alias("value")))
    rest = F.transform(
        F.array_sort(F.map_entries("labels")),
        lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")),
    )
    return gauges.select(
        F.concat(named, rest).alias("labels"),
        "value",
        (F.call_function("div", F.col("at_ms"), F.lit(1000)) * 1000).alias("timestamp_ms"),
    )
