"""A series that holds most rows is split over tasks by Spark's own skew handling."""

import re

import pytest
from pyspark.sql import functions as F

from tidelag.operators import history as H
from tidelag.operators import lag as L

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_samples(spark):
    """Half of 200,000 samples belong to one series; offsets never repeat, so nothing folds."""
    part = F.when(F.col("id") % 2 == 0, 0).otherwise((F.col("id") % 5000).cast("int")).alias("part")
    at = F.xxhash64("id").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at_ms")  # hard to compress
    return spark.range(0, 200_000, 1, 8).select(F.lit("c").alias("cluster"), F.lit("t").alias("topic"), part, F.col("id").alias("off"), at)


def ran(df):
    df.write.format("noop").mode("overwrite").save()
    collected = df.agg(F.count("*"))
    collected.collect()
    return collected._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name, build",
    [
        ("retain", lambda s: H.retain(s, 10**6)),
        ("merge", lambda s: H.retain(H.compress(H.merge_samples(s, s)), 10**6)),
        ("offset lag", lambda s: L.offset_lag(s.selectExpr("cluster", "'g' as grp", "topic", "part", "off as c_off"), H.latest_offsets(s))),
    ],
)
def test_hot_series_is_split(spark, small_partitions, name, build):
    samples = hot_samples(spark)
    out = build(samples)
    plan = ran(out.select("cluster", "part", F.col(out.columns[-1])).where(f"{out.columns[-1]} is not null"))
    assert re.search(r"skew=true", plan), name
