"""Registered queries: each takes (spark, directory of parquet tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag import functions as FN
from tidelag.functions import int_div, label_text
from tidelag.model import FACT, GROUP, TOPIC
from tidelag.operators import gauges as G
from tidelag.operators import groups as GR
from tidelag.operators import health as HE
from tidelag.operators import history as H
from tidelag.operators import lag as L
from tidelag.operators import members as M
from tidelag.operators import replay as R
from tidelag.operators import rollup as RO
from tidelag.plans import iteration as I
from tidelag.sources.derived import MEMBER_TTL_MS, RETENTION_SECONDS, TICK_MS, DerivedTables

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}

EXTRA_LABELS = {"env": "test", "group": "overridden"}
SHARDS = 7

LAG_COLUMNS = [*FACT, "c_off", "leo", "leo_at", "lag_off", "lag_s", "lag_s_case"]
ROLLED = ["max_off", "max_s", "sum_off", "sum_s"]


def query(build: Callable[[DerivedTables], DataFrame]) -> Callable[[DerivedTables], DataFrame]:
    """Register ``build`` under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(DerivedTables(spark, sf_dir))

    _REGISTRY[build.__name__] = run
    return build


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def _commits(t: DerivedTables) -> DataFrame:
    return L.valid_commits(t.committed()).select(*FACT, "c_off")


def _lags(t: DerivedTables) -> DataFrame:
    return L.partition_lag(_commits(t), t.offset_samples())


def _inputs(t: DerivedTables):
    return t.groups(), t.clusters(), t.rules(), t.committed(), t.offset_samples()


def _middle():
    return int_div(F.min("at_ms") + F.max("at_ms"), F.lit(2))


def _members(t: DerivedTables, now: Column) -> DataFrame:
    """Index of the members alive at a time that aggregates the member events."""
    events = t.member_events()
    return M.member_index(M.live_members(events, MEMBER_TTL_MS, events.agg(now).scalar()), bucket_ms=3600000)


# -- groups and commits --------------------------------------------------------


@query
def group_filter(t):
    return GR.filter_groups(t.groups(), t.rules()).select(*GROUP)


@query
def error_rows(t):
    return GR.group_errors(t.groups(), t.clusters(), t.rules())


@query
def surviving_groups(t):
    return GR.good_groups(t.groups(), t.clusters()).select(*GROUP)


@query
def valid_commits(t):
    return L.valid_commits(t.committed()).select(*FACT, "c_off", "snapshot_ms")


@query
def flatten_groups(t):
    return GR.flatten_groups(t.group_payloads())


@query
def union_of_clusters(t):
    """Tables of single clusters, their columns in different orders, as one."""
    samples = t.offset_samples()
    one, two = samples.where("cluster = 'c0'"), samples.where("cluster = 'c1'")
    return GR.union_clusters(one, two.select("at_ms", "off", "part", "topic", "cluster"))


@query
def groups_checked(t):
    return GR.groups_checked(I.chosen_groups(t.groups(), t.clusters(), t.rules()))


@query
def shard_assign(t):
    return GR.assign_shards(t.groups().select(*GROUP), SHARDS)


@query
def node_assignment(t):
    """Which live member looks after which group, as of the newest member event."""
    return GR.node_assignment(t.groups().select(*GROUP), _members(t, F.max("at_ms")))


@query
def moved_groups(t):
    """Groups whose member changed from the middle of the recorded time to its end."""
    return GR.moved_groups(t.groups().select(*GROUP), _members(t, _middle()), _members(t, F.max("at_ms")))


@query
def shard_balance(t):
    return GR.shard_balance(RO.group_rollup(_offset_lag(t).withColumn("lag_s", F.lit(None).cast("bigint"))), SHARDS)


@query
def leader_load(t):
    requests = GR.leader_requests(L.valid_commits(t.committed()), t.topic_meta(), batch=16)
    parts = F.array_join(F.transform("parts", lambda p: p.cast("string")), ",")
    return requests.select("cluster", "leader", "topic", "batch", parts.alias("parts"), "partitions")


@query
def partitions_without_leader(t):
    return GR.without_leader(L.valid_commits(t.committed()), t.topic_meta())


# -- history ---------------------------------------------------------------------


@query
def latest_offsets(t):
    return H.latest_offsets(H.valid_samples(t.offset_responses()))


@query
def message_log_end(t):
    return H.log_end_from_messages(t.messages())


@query
def series_key(t):
    return t.offset_samples().groupBy(FN.series_key().alias("series_key")).agg(F.count("*").alias("samples"))


@query
def history_compress(t):
    return H.compress_text(t.raw_members())


@query
def history_retention(t):
    return H.retain(t.offset_samples(), RETENTION_SECONDS)


@query
def known_samples(t):
    """Samples with a known offset and time, one per series and time."""
    return H.unique_times(t.unsure_samples())


@query
def history_merge(t):
    """Half of the samples merged into the other half, one half arriving twice."""
    samples = t.offset_samples()
    even = samples.where(int_div(F.col("at_ms"), F.lit(TICK_MS)) % 2 == 0)
    return H.retain(H.compress(H.merge_samples(samples, even)), RETENTION_SECONDS)


@query
def flat_run_compaction(t):
    return H.compact_flat_runs(t.offset_samples())


@query
def series_tail(t):
    return H.series_tail(t.offset_samples()).withColumn("rank", F.col("rank").cast("bigint"))


# -- lag -------------------------------------------------------------------------


def _offset_lag(t):
    return L.offset_lag(_commits(t), H.latest_offsets(t.offset_samples()))


@query
def offset_lag(t):
    return _offset_lag(t).select(*FACT, "c_off", "leo", "lag_off")


@query
def missing_offset_audit(t):
    missing = L.missing_offsets(t.committed(), H.latest_offsets(t.offset_samples()))
    return missing.groupBy("cluster", "skip_reason").agg(F.count("*").alias("partitions"))


@query
def time_lag(t):
    return _lags(t).select(*LAG_COLUMNS)


@query
def time_lag_window(t):
    return L.partition_lag_distinct(_commits(t), t.offset_samples()).select(*LAG_COLUMNS)


@query
def time_lag_array(t):
    return L.partition_lag_arrays(_commits(t), t.offset_samples()).select(*LAG_COLUMNS)


@query
def lag_with_read_failures(t):
    """The log ends are those just read; a failed or empty answer leaves them older or unknown."""
    latest = H.latest_offsets(H.valid_samples(t.offset_responses()))
    return L.partition_lag(_commits(t), t.offset_samples(), latest).select(*LAG_COLUMNS)


@query
def time_lag_text(t):
    """Against a history stored as text, some of whose times cannot be read."""
    return L.partition_lag(_commits(t), H.compress_text(t.raw_members())).select(*LAG_COLUMNS)


@query
def lag_case_profile(t):
    return L.lag_case_profile(_lags(t))


@query
def lag_replay(t):
    lags = R.lag_replay(t.commit_snapshots(), t.offset_samples(), RETENTION_SECONDS)
    return lags.select(*FACT, "snapshot_ms", *LAG_COLUMNS[4:])


# -- rollups ---------------------------------------------------------------------


@query
def topic_rollup(t):
    return RO.topic_rollup(_lags(t))


@query
def group_rollup(t):
    return RO.group_rollup(_lags(t))


@query
def lag_grouping_sets(t):
    return RO.lag_grouping_sets(_lags(t)).select(*TOPIC, "is_group", *ROLLED)


@query
def group_summary(t):
    return RO.group_summary(_lags(t))


@query
def group_topic_names(t):
    return RO.group_topic_names(_commits(t), chunk=3)


@query
def group_lag_report(t):
    return I.group_lag_report(*_inputs(t))


# -- gauges ----------------------------------------------------------------------


def _published(t: DerivedTables, extra: dict[str, str] | None = None) -> DataFrame:
    """All twelve metrics; the duration is that of the newest iteration on record."""
    spans = G.iteration_times(t.run_log())
    seconds = spans.agg((F.max_by("span_ms", "iteration") / 1000).alias("seconds"))
    return I.published_gauges(*_inputs(t), extra=extra, seconds=seconds)


def _flat_labels(gauges: DataFrame) -> DataFrame:
    return gauges.withColumn("labels", label_text(F.col("labels"), quote=False))


@query
def gauge_long(t):
    return _flat_labels(_published(t, EXTRA_LABELS))


@query
def backlog_gauges(t):
    """Every iteration of the recorded time at once, each from what it listed and read itself."""
    groups, log = t.iteration_groups(), t.commit_log().drop("seq")
    gauges = I.published_iterations(
        groups,
        t.clusters(),
        t.rules(),
        L.commits_by_snapshot(log),
        t.offset_samples(),
        t.offset_samples(),
        RETENTION_SECONDS,
        iterations=I.iterations_of(groups, log),
    )
    return _flat_labels(gauges).withColumnRenamed("snapshot_ms", "at_ms")


@query
def exposition_lines(t):
    return G.exposition(_published(t))


@query
def timeseries_rows(t):
    # times that differ from row to row and are not whole seconds
    gauges = _published(t).withColumn("at_ms", F.lit(1704067261789) + F.floor("value") * 977)
    pairs = F.transform("labels", lambda e: F.concat(e["name"], F.lit("="), e["value"]))
    return G.timeseries(gauges).withColumn("labels", F.array_join(pairs, ","))


@query
def gauge_last_value(t):
    lags = R.lag_replay(t.commit_snapshots(), t.offset_samples(), RETENTION_SECONDS)
    rolled = lags.groupBy(*TOPIC, "snapshot_ms").agg(
        F.max("lag_off").alias("max_off"),
        F.max("lag_s").alias("max_s"),
        F.sum("lag_off").alias("sum_off"),
        F.sum("lag_s").alias("sum_s"),
    )
    # All snapshots of a topic in one task, where last_values folds them before its own shuffle.
    rolled = rolled.repartition(*TOPIC)
    rows = rolled.withColumns({"level": F.lit("topic"), "part": F.lit(None).cast("int")})
    gauges = G.lag_gauges(rows).withColumnRenamed("snapshot_ms", "at_ms")
    return _flat_labels(G.last_values(gauges))


@query
def iteration_time(t):
    return G.iteration_times(t.run_log())


# -- members and health ----------------------------------------------------------


@query
def health_rollup(t):
    status = HE.health(HE.last_probes(t.probe_log()))
    return status.withColumn("unhealthy_clusters", F.array_join("unhealthy_clusters", ","))


@query
def health_by_hour(t):
    probes = t.probe_log().withColumn("hour", int_div(F.col("at_ms"), F.lit(3600000)))
    status = HE.health(HE.last_probes(probes, ["hour"]), ["hour"])
    return status.withColumn("unhealthy_clusters", F.array_join("unhealthy_clusters", ","))


@query
def member_sessions(t):
    return M.sessions(t.member_events().where("kind = 'beat'"), MEMBER_TTL_MS)


@query
def member_index(t):
    return _members(t, F.max("at_ms"))


@query
def member_index_at(t):
    """The index as it stood in the middle of the recorded time."""
    return _members(t, _middle())


@query
def newest_commits(t):
    return L.newest_commits(t.commit_log().drop("seq"))
