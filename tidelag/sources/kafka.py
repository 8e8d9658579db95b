"""Log ends from Kafka topics through Spark's Kafka source.

The source needs Spark's Kafka connector on the class path; the shaping of its
rows does not and works on any table with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_messages(spark: SparkSession, servers: str, topics: str, streaming: bool = False, **options: str) -> DataFrame:
    """Message positions of ``topics`` (comma-separated)."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").options(
        **{"kafka.bootstrap.servers": servers, "subscribe": topics, **options}
    ).load()


def as_messages(rows: DataFrame, cluster: str) -> DataFrame:
    """Rows of the Kafka source tagged with their cluster: cluster, topic, part, offset, at_ms."""
    return rows.select(
        F.lit(cluster).alias("cluster"),
        "topic",
        F.col("partition").alias("part"),
        "offset",
        F.unix_millis("timestamp").alias("at_ms"),
    )
