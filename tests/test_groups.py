import hashlib

from conftest import rows
from pyspark.sql import functions as F

from tidelag.functions import series_key, shard_of
from tidelag.operators import groups as GR

G = "cluster string, grp string, error string"
RULES = "cluster string, whitelist string, blacklist string"
CL = "cluster string, has_client boolean, has_config boolean, list_error string"


def listed(spark, *names, cluster="c"):
    return spark.createDataFrame([(cluster, n, None) for n in names], G)


def test_blacklist(spark):
    got = GR.filter_groups(listed(spark, "test-group-1", "test-group-2", "test-group-3"), spark.createDataFrame([("c", None, "^test-group-2$")], RULES))
    assert rows(got, "grp") == [("test-group-1",), ("test-group-3",)]


def test_whitelist_silences_blacklist(spark):
    got = GR.filter_groups(listed(spark, "app-1", "app-2", "other"), spark.createDataFrame([("c", "^app", "1$")], RULES))
    assert rows(got, "grp") == [("app-1",), ("app-2",)]


def test_patterns_are_unanchored_and_empty_means_unset(spark):
    groups = listed(spark, "my-app", "zzz")
    assert rows(GR.filter_groups(groups, spark.createDataFrame([("c", "app", None)], RULES)), "grp") == [("my-app",)]
    assert len(rows(GR.filter_groups(groups, spark.createDataFrame([("c", "", "")], RULES)))) == 2


def test_cluster_without_rules_is_skipped(spark):
    groups = GR.union_clusters(listed(spark, "a"), listed(spark, "b", cluster="d"))
    assert rows(GR.filter_groups(groups, spark.createDataFrame([("c", None, None)], RULES)), "cluster") == [("c",)]


def test_failures_are_isolated(spark):
    groups = spark.createDataFrame(
        [("ok", "a", None), ("ok", "b", "offset fetch failed"), ("down", "c", None), ("bare", "d", None), ("gone", "e", None), ("cut", "f", None)], G
    )
    clusters = spark.createDataFrame(
        [("ok", True, True, None), ("down", True, True, "listing failed"), ("bare", True, False, None), ("cut", False, True, None)], CL
    )
    assert rows(GR.good_groups(groups, clusters), "grp") == [("a",)]
    assert rows(GR.group_errors(groups, clusters), "grp", "scope", "reason") == [
        ("b", "group", "offset fetch failed"),
        ("c", "cluster", "listing failed"),
        ("d", "cluster", "no client config"),
        ("e", "cluster", "unknown cluster"),
        ("f", "cluster", "no client"),
    ]


def test_groups_of_a_cluster_without_rules_are_reported(spark):
    groups = spark.createDataFrame([("ok", "a", None), ("new", "b", None), ("new", "c", "offset fetch failed")], G)
    clusters = spark.createDataFrame([("ok", True, True, None), ("new", True, True, None)], CL)
    rules = spark.createDataFrame([("ok", None, None)], RULES)
    assert rows(GR.filter_groups(GR.good_groups(groups, clusters), rules), "grp") == [("a",)]
    assert rows(GR.group_errors(groups, clusters, rules), "grp", "scope", "reason") == [
        ("b", "cluster", "no configuration"),
        ("c", "cluster", "no configuration"),
    ]


def test_groups_checked_counts_empty_groups(spark):
    groups = GR.union_clusters(listed(spark, "a", "b", cluster="cluster1"), listed(spark, "x", cluster="cluster2"))
    assert rows(GR.groups_checked(groups)) == [("cluster1", 2), ("cluster2", 1)]
    rolled = spark.createDataFrame([("cluster1", "a", 5)], "cluster string, grp string, max_off bigint")
    assert rows(GR.with_empty_groups(groups, rolled), "grp", "max_off") == [("a", 5), ("b", None), ("x", None)]


def test_alternating_groups(spark):
    groups = spark.createDataFrame([(f"cluster{i % 2}", f"g{i}", None) for i in range(10)], G)
    assert rows(GR.groups_checked(groups)) == [("cluster0", 5), ("cluster1", 5)]


def test_shards_follow_sha256(spark):
    names = ["", "a", "test-group", "grüppe", "x" * 500]
    got = dict(rows(spark.createDataFrame([(n,) for n in names], "grp string").select("grp", shard_of("grp", 7))))
    assert got == {n: int.from_bytes(hashlib.sha256(n.encode()).digest()[:4], "big") % 7 for n in names}
    rolled = spark.createDataFrame([("c", n, 2) for n in names], "cluster string, grp string, sum_off bigint")
    balance = rows(GR.shard_balance(rolled, 7), "groups", "sum_off")
    assert sum(g for g, _ in balance) == 5 and sum(s for _, s in balance) == 10


def test_flatten(spark):
    nested = spark.createDataFrame(
        [("c", "g", [("t", [(0, 5), (1, 6)]), ("u", [(0, 7)]), ("v", [])]), ("c", "empty", [])],
        "cluster string, grp string, topics array<struct<topic:string,partitions:array<struct<part:int,c_off:bigint>>>>",
    )
    assert rows(GR.flatten_groups(nested)) == [("c", "g", "t", 0, 5), ("c", "g", "t", 1, 6), ("c", "g", "u", 0, 7)]


def test_leader_requests_are_keyed_by_topic_and_batched(spark):
    commits = spark.createDataFrame(
        [("c", "g", "t", p) for p in (0, 1, 5)] + [("c", "h", "t", 0), ("c", "g", "u", 0), ("c", "g", "w", 0), ("c", "g", "x", 0)],
        "cluster string, grp string, topic string, part int",
    )
    meta = spark.createDataFrame(
        [("c", "t", 0, 1), ("c", "t", 1, 1), ("c", "t", 5, 1), ("c", "u", 0, 2), ("c", "w", 0, None)],
        "cluster string, topic string, part int, leader int",
    )
    got = rows(GR.leader_requests(commits, meta, batch=4), "leader", "topic", "batch", "parts", "partitions")
    assert got == [(1, "t", 0, [0, 1], 2), (1, "t", 1, [5], 1), (2, "u", 0, [0], 1)]
    assert rows(GR.without_leader(commits, meta), "topic") == [("w",), ("x",)]


def test_series_key(spark):
    frame = spark.createDataFrame([("c", "t", 3)], "cluster string, topic string, part int")
    assert rows(frame.select(series_key())) == [("c:t:3",)]
    assert frame.select(F.length(series_key())).first()[0] == 5
