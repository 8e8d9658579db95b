"""Which consumer groups are looked at, and what becomes of failures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelag.functions import shard_of
from tidelag.model import FACT, GROUP


def union_clusters(*frames: DataFrame) -> DataFrame:
    """One table from per-cluster tables, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def allowed(grp: Column, whitelist: Column, blacklist: Column) -> Column:
    """A whitelist decides alone; otherwise the blacklist excludes; an empty pattern is unset."""
    white, black = F.nullif(whitelist, F.lit("")), F.nullif(blacklist, F.lit(""))
    return (
        F.when(white.isNotNull(), F.call_function("rlike", grp, white))
        .when(black.isNotNull(), ~F.call_function("rlike", grp, black))
        .otherwise(True)
    )


def filter_groups(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """Groups allowed by the rules of their cluster; a cluster without rules is skipped.

    The rules side is left to Spark's own size-checked broadcast.
    """
    return (
        groups.join(rules, "cluster")
        .where(allowed(F.col("grp"), F.col("whitelist"), F.col("blacklist")))
        .drop("whitelist", "blacklist")
    )


def usable_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters that can be asked at all: connected, configured and listing without error."""
    return clusters.where(F.col("has_client") & F.col("has_config") & F.col("list_error").isNull())


def good_groups(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """Groups that survive cluster and group failures."""
    return groups.where("error is null").join(usable_clusters(clusters), "cluster", "left_semi")


def group_errors(groups: DataFrame, clusters: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Groups dropped by a failure, with its scope and reason; the others are unaffected.

    With ``rules`` the groups that ``filter_groups`` skips for want of a rules row are reported too.
    """
    reason = (
        F.when(F.col("has_client").isNull(), "unknown cluster")
        .when(~F.col("has_client"), "no client")
        .when(~F.col("has_config"), "no client config")
        .when(F.col("list_error").isNotNull(), F.col("list_error"))
        .when(~F.col("has_rules"), "no configuration")
    )
    known = groups.join(clusters, "cluster", "left")
    if rules is None:
        known = known.withColumn("has_rules", F.lit(True))
    else:
        ruled = rules.select("cluster", F.lit(True).alias("ruled")).distinct()
        known = known.join(ruled, "cluster", "left").withColumn("has_rules", F.coalesce("ruled", F.lit(False)))
    return (
        known
        .withColumn("cluster_reason", reason)
        .withColumn("scope", F.when(F.col("cluster_reason").isNotNull(), "cluster").otherwise("group"))
        .withColumn("reason", F.coalesce("cluster_reason", "error"))
        .where("reason is not null")
        .select(*GROUP, "scope", "reason")
    )


def flatten_groups(payloads: DataFrame) -> DataFrame:
    """Flat positions from nested groups: ``topics array<struct<topic, partitions array<struct<part, c_off>>>>``."""
    return (
        payloads.select(*GROUP, F.explode("topics").alias("t"))
        .select(*GROUP, F.col("t.topic").alias("topic"), F.explode("t.partitions").alias("p"))
        .select(*FACT[:3], F.col("p.part").alias("part"), F.col("p.c_off").alias("c_off"))
    )


def groups_checked(groups: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Groups looked at per cluster; groups without any valid commit count too."""
    return groups.groupBy(*carried, "cluster").agg(F.count("*").alias("groups_checked"))


def with_empty_groups(groups: DataFrame, rolled: DataFrame) -> DataFrame:
    """Every checked group, with NULL lag where it has no valid commit."""
    return groups.select(*GROUP).join(rolled, GROUP, "left")


def assign_shards(groups: DataFrame, shards: int | Column) -> DataFrame:
    return groups.withColumn("shard", shard_of("grp", shards))


def _owners(index: DataFrame, suffix: str = "") -> DataFrame:
    shard, member = f"shard{suffix}", f"member{suffix}"
    return index.select(F.col("member_index").cast("bigint").alias(shard), F.col("member").alias(member))


def node_assignment(groups: DataFrame, index: DataFrame) -> DataFrame:
    """Every group with the live member that looks after it: the one whose index is the group's shard.

    ``index`` is ``members.member_index``; there are as many shards as live members.  Without any, groups have none.
    """
    members = index.agg(F.max("members")).scalar()
    return assign_shards(groups, members).join(_owners(index), "shard", "left")


def moved_groups(groups: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Groups that another member looks after once the membership has changed: member_before, member_after.

    A member that stays may get another index, and the count of shards may change, so groups move between members
    that were there all along, too.
    """
    placed = groups
    for suffix, index in (("_before", before), ("_after", after)):
        members = index.agg(F.max("members")).scalar()
        placed = placed.withColumn(f"shard{suffix}", shard_of("grp", members))
        placed = placed.join(_owners(index, suffix), f"shard{suffix}", "left")
    return placed.where(~F.col("member_before").eqNullSafe(F.col("member_after"))).drop("shard_before", "shard_after")


def shard_balance(rolled: DataFrame, shards: int) -> DataFrame:
    """Groups and lag per shard."""
    return (
        assign_shards(rolled, shards)
        .groupBy("shard")
        .agg(F.count("*").alias("groups"), F.sum("sum_off").alias("sum_off"))
    )


def leader_requests(committed: DataFrame, topic_meta: DataFrame, batch: int = 1024) -> DataFrame:
    """Partitions to ask each leader for, in batches of at most ``batch`` partition numbers.

    Partitions without a leader are not asked.
    """
    wanted = committed.select("cluster", "topic", "part").distinct()
    return (
        wanted.join(topic_meta, ["cluster", "topic", "part"])
        .where("leader is not null")
        .withColumn("batch", F.call_function("div", F.col("part"), F.lit(batch)).cast("int"))
        .groupBy("cluster", "leader", "topic", "batch")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"), F.count("*").alias("partitions"))
    )


def without_leader(committed: DataFrame, topic_meta: DataFrame) -> DataFrame:
    """Distinct partitions that cannot be asked because no leader is known."""
    wanted = committed.select("cluster", "topic", "part").distinct()
    return wanted.join(topic_meta, ["cluster", "topic", "part"], "left").where("leader is null").drop("leader")
