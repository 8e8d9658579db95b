"""One polling iteration as a single lazy plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.model import FACT, GROUP
from tidelag.operators.gauges import checked_gauges, iteration_gauge, lag_gauges
from tidelag.operators.groups import filter_groups, good_groups, groups_checked, with_empty_groups
from tidelag.operators.history import iteration_ends, read_in_iteration
from tidelag.operators.lag import partition_lag, valid_commits, with_lag
from tidelag.operators.replay import replay_neighbours
from tidelag.operators.rollup import all_levels, group_rollup


def chosen_groups(groups: DataFrame, clusters: DataFrame, rules: DataFrame) -> DataFrame:
    """Groups that pass the failure checks and the rules of their cluster."""
    return filter_groups(good_groups(groups, clusters), rules).select(*GROUP)


def commits_of(chosen: DataFrame, committed: DataFrame) -> DataFrame:
    """Valid commits of the chosen groups."""
    return valid_commits(committed).join(chosen, GROUP, "left_semi").select(*FACT, "c_off")


def group_lag_report(
    groups: DataFrame, clusters: DataFrame, rules: DataFrame, committed: DataFrame, samples: DataFrame
) -> DataFrame:
    """Lag of every checked group, empty groups included."""
    chosen = chosen_groups(groups, clusters, rules)
    return with_empty_groups(chosen, group_rollup(partition_lag(commits_of(chosen, committed), samples)))


def published_gauges(
    groups: DataFrame,
    clusters: DataFrame,
    rules: DataFrame,
    committed: DataFrame,
    samples: DataFrame,
    extra: Mapping[str, str] | None = None,
    latest: DataFrame | None = None,
    seconds: DataFrame | None = None,
) -> DataFrame:
    """All gauges of the iteration: name, labels, value; its duration only where ``seconds`` gives it."""
    chosen = chosen_groups(groups, clusters, rules)
    lags = partition_lag(commits_of(chosen, committed), samples, latest)
    gauges = lag_gauges(all_levels(lags), extra).unionByName(checked_gauges(groups_checked(chosen), extra))
    return gauges if seconds is None else gauges.unionByName(iteration_gauge(seconds))


def iterations_of(groups: DataFrame, committed: DataFrame) -> DataFrame:
    """The distinct iterations (cluster, snapshot_ms) of listed groups and commits."""
    of = lambda df: df.select("cluster", "snapshot_ms").where("cluster is not null and snapshot_ms is not null")
    return of(groups).unionByName(of(committed)).distinct()


def iteration_lags(
    groups: DataFrame,
    committed: DataFrame,
    samples: DataFrame,
    history: DataFrame,
    iterations: DataFrame,
    ttl_seconds: int,
    slack_ms: int = 0,
) -> DataFrame:
    """Lag of every position in every iteration, against the history and the log ends that iteration had.

    ``groups``: the chosen (cluster, grp, snapshot_ms).  An iteration sees the history from ``ttl_seconds`` before its
    snapshot to ``slack_ms`` after it, but nothing that a later iteration read.  Its log ends are those of the ``samples`` it read
    itself, told by their time from those of the other ``iterations`` (cluster, snapshot_ms); a series not read then
    gets no lag in it.
    """
    at = [*GROUP, "snapshot_ms"]
    commits = valid_commits(committed).join(groups.select(*at), at, "left_semi").select(*FACT, "c_off", "snapshot_ms")
    ends = iteration_ends(iterations, slack_ms)
    of = ["cluster", "snapshot_ms"]
    read = read_in_iteration(samples, iterations, slack_ms).join(ends, of)
    placed = replay_neighbours(commits.join(ends, of), history, ttl_seconds * 1000, slack_ms, seen="seen_ms", read=read)
    return with_lag(placed.drop("seen_ms"))


def published_iterations(
    groups: DataFrame,
    clusters: DataFrame,
    rules: DataFrame,
    committed: DataFrame,
    samples: DataFrame,
    history: DataFrame,
    ttl_seconds: int,
    slack_ms: int = 0,
    extra: Mapping[str, str] | None = None,
    iterations: DataFrame | None = None,
) -> DataFrame:
    """``published_gauges`` for each of many iterations at once, with ``snapshot_ms``: name, labels, value, snapshot_ms.

    Groups and commits carry the ``snapshot_ms`` of their iteration.  What one iteration did not list or could not read
    has no part in it, whatever the others hold; clusters keep their own time.  ``iterations`` (cluster, snapshot_ms) are
    those of groups and commits unless given, as where they can be had without working out ``committed``.
    """
    if iterations is None:
        iterations = iterations_of(groups, committed)
    chosen = filter_groups(good_groups(groups, clusters), rules).select(*GROUP, "snapshot_ms")
    lags = iteration_lags(chosen, committed, samples, history, iterations, ttl_seconds, slack_ms)
    checked = groups_checked(chosen, ["snapshot_ms"])
    return lag_gauges(all_levels(lags, ["snapshot_ms"]), extra).unionByName(checked_gauges(checked, extra))
