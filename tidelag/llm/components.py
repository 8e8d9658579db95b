"""Connected components of an edge table, by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.llm.common import written

MAX_ROUNDS = 60  # far above the logarithmic number that any graph needs; passing it raises


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link nodes to the least node of their neighbourhood: the larger neighbours, or the smaller ones and the node.

    ``edges`` holds (u, v) with u > v.  The least neighbour is a partial aggregate, so a hub with very many
    neighbours is combined before the shuffle; the join back has plain inputs, so a hot hub can be split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = both.where("v > u").join(least.hint("rebalance"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least.hint("rebalance"), "u")
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return linked.where("u <> v").distinct()


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, component) of every node of ``edges`` (columns a, b): the least id that the node reaches.

    Self-links, repeated links and NULL ends are ignored; no edges give no rows.
    """
    now = (
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    now = written(now, folder, f"{name}-0")
    state = None
    for step in range(1, MAX_ROUNDS):
        now = written(_star(_star(now, large=True), large=False), folder, f"{name}-{step}")
        before = state
        total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        state = tuple(now.agg(F.count(F.lit(1)), total).first())
        if state == before or state[0] == 0:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
