"""Reading the inputs of many clusters so that one that cannot be read costs only itself."""

from __future__ import annotations

from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_clusters(
    spark: SparkSession, paths: Mapping[str, str], schema: T.StructType, folder: str
) -> tuple[DataFrame, DataFrame]:
    """(rows of the clusters that could be read, clusters): one job per cluster copies its input to ``folder``.

    ``paths``: the parquet input of each cluster, with the columns of ``schema`` other than ``cluster``.  A damaged file
    shows only once it is read, so every input is read to its end here, and nothing of a cluster that failed half-way
    counts.  ``clusters`` has a row per cluster in the form that ``groups.good_groups`` and ``groups.group_errors`` take,
    with what went wrong as its ``list_error``.  ``folder`` lies in storage that all executors share.
    """
    own = T.StructType([f for f in schema if f.name != "cluster"])
    states, read = [], []
    for number, (cluster, path) in enumerate(sorted(paths.items())):
        target = f"{folder.rstrip('/')}/{number}"
        try:
            spark.read.schema(own).parquet(path).write.mode("overwrite").parquet(target)
        except (PySparkException, Py4JJavaError) as failure:
            condition = failure.getCondition() if isinstance(failure, PySparkException) else None
            states.append((cluster, True, True, f"unreadable input: {condition or 'read failed'}"))
            continue
        states.append((cluster, True, True, None))
        read.append(spark.read.schema(own).parquet(target).withColumn("cluster", F.lit(cluster)).select(*schema.names))
    rows = spark.createDataFrame([], schema)
    for part in read:
        rows = rows.unionByName(part)
    clusters = spark.createDataFrame(states, "cluster string, has_client boolean, has_config boolean, list_error string")
    return rows, clusters
