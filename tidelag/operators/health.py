"""Health of clusters and of the history store from a probe log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_probes(probes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Result of the newest probe per target; a failure wins over a success at the same time."""
    newest = probes.groupBy(*by, "cluster", "at_ms").agg(F.min("ok").alias("ok"))
    return newest.groupBy(*by, "cluster").agg(F.max_by("ok", "at_ms").alias("ok"))


def health(last: DataFrame, by: Sequence[str] = (), store: str = "store") -> DataFrame:
    """``OK`` if any cluster and the store answer, and the clusters that do not.

    One row overall, or one per check when ``by`` names the column of the check.
    """
    is_store = F.col("cluster") == store
    any_cluster = F.coalesce(F.bool_or(F.when(~is_store, F.col("ok"))), F.lit(False))
    store_up = F.coalesce(F.bool_and(F.when(is_store, F.col("ok"))), F.lit(False))
    down = F.collect_set(F.when(~is_store & ~F.col("ok"), F.col("cluster")))
    return last.groupBy(*by).agg(
        F.when(any_cluster & store_up, "OK").otherwise("Unhealthy").alias("status"),
        F.array_sort(down).alias("unhealthy_clusters"),
    )
