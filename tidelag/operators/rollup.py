"""Max and sum of lag per topic and per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.model import FACT, GROUP, TOPIC


def topic_rollup(lags: DataFrame) -> DataFrame:
    """Per topic: largest and total lag over the partitions where it is known."""
    return lags.groupBy(*TOPIC).agg(
        F.max("lag_off").alias("max_off"),
        F.max("lag_s").alias("max_s"),
        F.sum("lag_off").alias("sum_off"),
        F.sum("lag_s").alias("sum_s"),
    )


def _behind(lag: str = "lag_s"):
    # A group's maximum ignores negative seconds; topic maxima and sums do not.
    return F.when(F.col(lag) >= 0, F.col(lag))


def group_rollup(lags: DataFrame) -> DataFrame:
    """Per group: largest and total lag over all its topics."""
    return lags.groupBy(*GROUP).agg(
        F.max("lag_off").alias("max_off"),
        F.max(_behind()).alias("max_s"),
        F.sum("lag_off").alias("sum_off"),
        F.sum("lag_s").alias("sum_s"),
    )


def lag_grouping_sets(lags: DataFrame) -> DataFrame:
    """Topic and group rollups in one result; ``is_group`` is 1 on group rows (topic NULL).

    Partitions are folded to topics first, so only topic rows are expanded
    into the two grouping sets.
    """
    topics = lags.groupBy(*TOPIC).agg(
        F.max("lag_off").alias("max_off"),
        F.max("lag_s").alias("max_s"),
        F.max(_behind()).alias("max_behind_s"),
        F.sum("lag_off").alias("sum_off"),
        F.sum("lag_s").alias("sum_s"),
    )
    cols = [F.col(c) for c in TOPIC]
    return (
        topics.groupingSets([cols, cols[:2]], *cols)
        .agg(
            F.grouping("topic").cast("int").alias("is_group"),
            F.max("max_off").alias("max_off"),
            F.max("max_s").alias("any_max_s"),
            F.max("max_behind_s").alias("max_behind_s"),
            F.sum("sum_off").alias("sum_off"),
            F.sum("sum_s").alias("sum_s"),
        )
        .withColumn(
            "max_s", F.when(F.col("is_group") == 1, F.col("max_behind_s")).otherwise(F.col("any_max_s"))
        )
        .drop("any_max_s", "max_behind_s")
    )


def all_levels(lags: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Partition, topic and group rows in one pass, told apart by ``level``.

    The lag behind this is the costly part of an iteration; one expand over it
    is cheaper than computing it once per level.  Topic and group rows fold
    map-side, so the shuffle stays close to one row per partition.
    ``carried`` names columns, such as the snapshot, that are kept apart on every level.
    """
    cols, kept = [F.col(c) for c in FACT], [F.col(c) for c in carried]
    rolled = lags.groupingSets([kept + cols, kept + cols[:3], kept + cols[:2]], *kept, *cols).agg(
        (F.grouping("topic") + F.grouping("part")).cast("int").alias("depth"),
        F.max("lag_off").alias("max_off"),
        F.max("lag_s").alias("any_max_s"),
        F.max(_behind()).alias("max_behind_s"),
        F.sum("lag_off").alias("sum_off"),
        F.sum("lag_s").alias("sum_s"),
    )
    level = F.element_at(F.array(*[F.lit(x) for x in ("partition", "topic", "group")]), F.col("depth") + 1)
    return rolled.select(
        *carried,
        *FACT,
        level.alias("level"),
        "max_off",
        F.when(F.col("depth") == 2, F.col("max_behind_s")).otherwise(F.col("any_max_s")).alias("max_s"),
        "sum_off",
        "sum_s",
    )


def names_in_lines(rows: DataFrame, by: list[str], name: str, chunk: int) -> DataFrame:
    """Distinct ``name`` values of each key as text, about ``chunk`` names per line, sorted inside a line.

    A name's hash picks its line among as many as the key needs, so no sort or
    group ever holds all names of a key, however many it has.
    """
    distinct = rows.select(*by, name).distinct()
    needed = distinct.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(chunk)).alias("lines"))
    number = F.conv(F.substring(F.sha2(F.col(name).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return (
        distinct.join(needed.hint("rebalance"), by)
        .withColumn("line", number % F.col("lines"))
        .groupBy(*by, "line")
        .agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("names"))
    )


def group_topic_names(lags: DataFrame, chunk: int = 1000) -> DataFrame:
    """The topic names of each group, in lines of about ``chunk``; holds no sums, so none can be counted twice."""
    return names_in_lines(lags, GROUP, "topic", chunk)


def group_summary(lags: DataFrame) -> DataFrame:
    """Exactly one row per group: its rollup and its number of topics, from one fold to topics."""
    topics = lags.groupBy(*TOPIC).agg(
        F.max("lag_off").alias("max_off"),
        F.max(_behind()).alias("max_s"),
        F.sum("lag_off").alias("sum_off"),
        F.sum("lag_s").alias("sum_s"),
    )
    return topics.groupBy(*GROUP).agg(
        F.max("max_off").alias("max_off"),
        F.max("max_s").alias("max_s"),
        F.sum("sum_off").alias("sum_off"),
        F.sum("sum_s").alias("sum_s"),
        F.count("topic").alias("topics"),
    )
