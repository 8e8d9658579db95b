"""The registered queries as plain SQL for another engine, written independently.

Lag is stated here in the obvious way (join every sample, pick by aggregate);
the Spark side never does that.
"""

from __future__ import annotations

import re

from tidelag.operators.gauges import HELP

TICK = 21600000
TTL = 604800000
MEMBER_TTL = 43200000

_OWNER = """case when {k} % 19 = 5 then 'c9' when {k} % 19 = 6 then 'c8'
       else concat('c', cast({k} % 2 as varchar)) end as cluster, concat('grp-', cast({k} as varchar)) as grp"""
_TOPIC = "['click','error','purchase','signup','view'][l_linenumber % 5 + 1]"

_CTE: dict[str, str] = {
    "plog": """select concat('c', cast(user_id % 2 as varchar)) as cluster, event_type as topic,
       cast(user_id // 2 as integer) as part, epoch_us(ts) // 1000 as ts_ms,
       cast(floor(value) as bigint) + 1 as qty, event_id from events""",
    "ticks": f"""select cluster, topic, part, ts_ms // {TICK} + 1 as h, cast(sum(qty) as bigint) as qty
       from plog group by all""",
    "runs": """select cluster, topic, part, h,
       cast(sum(qty) over (partition by cluster, topic, part order by h) as bigint) as off,
       lead(h) over (partition by cluster, topic, part order by h) as next_h from ticks""",
    "samples": f"""select cluster, topic, part, off, tick * {TICK} as at_ms from
       (select *, unnest(generate_series(h, coalesce(next_h - 1, h))) as tick from runs)""",
    "members_raw": """select cluster, topic, part, off - back as off,
       case when off % 97 = 5 then concat('x', cast(at_ms as varchar)) else cast(at_ms as varchar) end as member
       from samples, (values (0), (1)) b(back)""",
    "commit_log": f"""select {_OWNER.format(k='l_suppkey')}, {_TOPIC} as topic, cast(l_partkey // 20 as integer) as part,
       case when l_suppkey % 17 = 3 or l_partkey % 31 = 5 then -1
            else (l_orderkey * 7 + l_partkey * 13) % 900 end as c_off,
       case when l_orderkey % 13 = 6 then 3 else 0 end as err_code,
       (l_orderkey % 124 + 78892) * {TICK} as snapshot_ms from lineitem""",
    "committed": """select * from commit_log
       qualify row_number() over (partition by cluster, grp, topic, part
                                  order by snapshot_ms desc, c_off desc, err_code desc) = 1""",
    "snapshots": """select cluster, grp, topic, part, snapshot_ms, max(c_off) as c_off from commit_log
       where err_code = 0 and c_off >= 0 group by all""",
    "commits": "select cluster, grp, topic, part, c_off, snapshot_ms from committed where err_code = 0 and c_off >= 0",
    "groups": f"""select {_OWNER.format(k='s_suppkey')},
       case when s_suppkey % 23 = 7 then 'offset fetch failed'
            when s_suppkey % 29 = 11 then 'topic description failed' end as error from supplier""",
    "clusters": """select distinct cluster, true as has_client, cluster <> 'c9' as has_config,
       case when cluster = 'c8' then 'group listing failed' end as list_error from groups""",
    "rules": """select * from (values ('c0', '[0246]$', '4$'), ('c1', null, '1$'), ('c8', null, null))
       r(cluster, whitelist, blacklist)""",
    "filtered": """select g.* from groups g join rules r using (cluster)
       where case when whitelist is not null then regexp_matches(grp, whitelist)
                  when blacklist is not null then not regexp_matches(grp, blacklist) else true end""",
    "surviving": """select g.* from groups g where error is null and exists
       (select 1 from clusters c where c.cluster = g.cluster and has_client and has_config and list_error is null)""",
    "chosen": "select cluster, grp from filtered where (cluster, grp) in (select (cluster, grp) from surviving)",
    "topic_meta": """select distinct cluster, topic, part,
       case when part % 11 <> 10 then cast((length(topic) + part) % 7 as integer) end as leader from plog""",
    "latest": "select cluster, topic, part, arg_max(off, at_ms) as leo, max(at_ms) as leo_at from samples group by all",
    "history": "select cluster, topic, part, off, max(at_ms) as at_ms from samples group by all",
    "windowed": f"""select c.cluster, c.grp, c.topic, c.part, c.snapshot_ms, c.c_off, h.off, max(h.at_ms) as at_ms
       from snapshots c left join samples h on h.cluster = c.cluster and h.topic = c.topic and h.part = c.part
       and h.at_ms <= c.snapshot_ms and h.at_ms >= c.snapshot_ms - {TTL}
       group by all""",
    "replayed": """select cluster, grp, topic, part, snapshot_ms, c_off,
       arg_max(off, at_ms) as leo, max(at_ms) as leo_at, count(off) as n,
       max(off) filter (off <= c_off) as lo_off, arg_max(at_ms, off) filter (off <= c_off) as lo_at,
       min(off) filter (off > c_off) as up_off, arg_min(at_ms, off) filter (off > c_off) as up_at
       from windowed group by all""",
}

_LOCATED = """select c.cluster, c.grp, c.topic, c.part, c.c_off, l.leo, l.leo_at, count(h.off) as n,
       max(h.off) as max_off, min(h.off) filter (h.at_ms is null) as bad_off,
       max(h.off) filter (h.off <= c.c_off) as lo_off, arg_max(h.at_ms, h.off) filter (h.off <= c.c_off) as lo_at,
       min(h.off) filter (h.off > c.c_off) as up_off, arg_min(h.at_ms, h.off) filter (h.off > c.c_off) as up_at
       from commits c left join {latest} l using (cluster, topic, part) left join {history} h using (cluster, topic, part)
       group by c.cluster, c.grp, c.topic, c.part, c.c_off, l.leo, l.leo_at"""

_CTE["latest_read"] = """select cluster, topic, part, arg_max(off, at_ms) as leo, max(at_ms) as leo_at from samples
       where off % 17 <> 3 and off % 19 <> 4 group by all"""
_CTE["history_text"] = """select cluster, topic, part, off, try_cast(max(member) as bigint) as at_ms from
       (select cluster, topic, part, member, max(off) as off from members_raw group by all) group by cluster, topic, part, off"""
_CTE["latest_text"] = "select cluster, topic, part, arg_max(off, at_ms) as leo, max(at_ms) as leo_at from history_text group by all"
_CTE["located"] = _LOCATED.format(latest="latest", history="history")
_CTE["located_read"] = _LOCATED.format(latest="latest_read", history="history")
_CTE["located_text"] = _LOCATED.format(latest="latest_text", history="history_text")

_BAD = "bad_off <= case when lo_off = c_off then c_off else coalesce(up_off, max_off) end"

_LAG_SELECT = """select {keys}, leo, leo_at, case when leo is not null then greatest(leo - c_off, 0) end as lag_off,
       case when leo is null then null when n < 2 then 'insufficient' {unparsed} when lo_off = c_off then 'exact'
            when lo_off is null then 'below' when up_off is null then 'above' else 'interp' end as lag_s_case,
       nullif((leo_at - case when n < 2 then null {unknown} when lo_off = c_off then lo_at when lo_off is null then up_at
            when up_off is null then lo_at
            else lo_at + ((c_off - lo_off) * (up_at - lo_at)) // (up_off - lo_off) end) // 1000, -1) as lag_s
       from {source}"""



def _lag_select(source: str, snapshot: str = "", text: bool = False) -> str:
    return _LAG_SELECT.format(
        keys=f"cluster, grp, topic, part, {snapshot}c_off",
        source=source,
        unparsed=f"when {_BAD} then 'unparsed'" if text else "",
        unknown=f"when {_BAD} then null" if text else "",
    )


_CTE["lags"] = _lag_select("located")
_CTE["read_lags"] = _lag_select("located_read")
_CTE["text_lags"] = _lag_select("located_text", text=True)
_CTE["replay_lags"] = _lag_select("replayed", snapshot="snapshot_ms, ")
_CTE["chosen_lags"] = "select * from lags where (cluster, grp) in (select (cluster, grp) from chosen)"

_SUMS = "max(lag_off) as max_off, {max_s} as max_s, cast(sum(lag_off) as bigint) as sum_off, cast(sum(lag_s) as bigint) as sum_s"
_TOPIC_SUMS = _SUMS.format(max_s="max(lag_s)")
_GROUP_SUMS = _SUMS.format(max_s="max(lag_s) filter (lag_s >= 0)")

_CTE["topic_level"] = f"select cluster, grp, topic, {_TOPIC_SUMS} from chosen_lags group by all"
_CTE["group_level"] = f"select cluster, grp, {_GROUP_SUMS} from chosen_lags group by all"


def _gauge_rows(extra: str = "") -> str:
    """Union of all gauges as (name, labels text, value).

    ``extra`` is 'merge' to apply the extra labels, 'then' for all iterations, with their times.
    """
    merged = extra == "merge"

    def labels(group: bool, topic: bool = False, part: bool = False) -> str:
        bits = ["'clustername=' || cluster"]
        if merged:
            bits.append("'env=test'")
            bits.append("'group=overridden'")
        elif group:
            bits.append("'group=' || grp")
        if part:
            bits.append("'partition=' || cast(part as varchar)")
        if topic:
            bits.append("'topic=' || topic")
        return " || ',' || ".join(bits)

    then, at = (True, ", snapshot_ms as at_ms") if extra == "then" else (False, "")
    rows = []
    for stem, col in (("lag_in_offsets", "lag_off"), ("lag_in_seconds", "lag_s")):
        rows.append((stem, labels(True, True, True), col, "chosen_lags"))
    for source, prefix, topic in (("topic_level", "topic_", True), ("group_level", "", False)):
        for kind in ("max", "sum"):
            for unit, suffix in (("offsets", "off"), ("seconds", "s")):
                rows.append((f"{prefix}{kind}_lag_in_{unit}", labels(True, topic), f"{kind}_{suffix}", source))
    tables = {"chosen_lags": "lags_then", "topic_level": "topics_then", "group_level": "groups_then"}
    parts = [
        f"select 'kafka_consumer_group_{stem}' as name, {text} as labels, cast({col} as double) as value{at}"
        f" from {tables[source] if then else source}"
        f" where {col} is not null and {col} <> -1"
        for stem, text, col, source in rows
    ]
    checked = "listed_chosen group by cluster, snapshot_ms" if then else "chosen group by cluster"
    parts.append(
        f"select 'kafka_total_groups_checked' as name, {labels(False)} as labels, cast(count(*) as double) as value{at}"
        f" from {checked}"
    )
    if then:
        return " union all ".join(parts)
    parts.append("select 'kafka_iteration_time_seconds' as name, '' as labels, seconds as value from newest_iteration")
    return " union all ".join(parts)


_CTE["iterations"] = f"select ts_ms // {TICK} as iteration, max(ts_ms) - min(ts_ms) as span_ms from plog group by all"
_CTE["newest_iteration"] = "select cast(arg_max(span_ms, iteration) as double) / 1000 as seconds from iterations"
_CTE["gauges"] = _gauge_rows()
_CTE["extra_gauges"] = _gauge_rows("merge")
_CTE["replay_topics"] = f"select cluster, grp, topic, snapshot_ms, {_TOPIC_SUMS} from replay_lags group by all"
_CTE["replay_gauges"] = " union all ".join(
    f"select 'kafka_consumer_group_topic_{kind}_lag_in_{unit}' as name,"
    f" 'clustername=' || cluster || ',group=' || grp || ',topic=' || topic as labels,"
    f" cast({kind}_{suffix} as double) as value, snapshot_ms as at_ms from replay_topics"
    f" where {kind}_{suffix} is not null and {kind}_{suffix} <> -1"
    for kind in ("max", "sum")
    for unit, suffix in (("offsets", "off"), ("seconds", "s"))
)
# Every iteration at once: groups as listed in it, the log ends read since the iteration before it.
_CTE["listed"] = f"""select distinct {_OWNER.format(k='l_suppkey')}, (l_orderkey % 124 + 78892) * {TICK} as snapshot_ms,
       case when (l_suppkey + l_orderkey % 124 + 78892) % 23 = 7 then 'offset fetch failed' end as error from lineitem"""
_CTE["listed_chosen"] = """select cluster, grp, snapshot_ms from listed where error is null
       and cluster in (select cluster from clusters where has_client and has_config and list_error is null)
       and (cluster, grp) in (select (cluster, grp) from filtered)"""
_CTE["moments"] = "select distinct cluster, snapshot_ms from listed"
_CTE["read_then"] = """select s.*, m.snapshot_ms from samples s join moments m on m.cluster = s.cluster and m.snapshot_ms = s.at_ms"""
_CTE["latest_then"] = """select cluster, topic, part, snapshot_ms, arg_max(off, at_ms) as leo, max(at_ms) as leo_at
       from read_then group by all"""
_CTE["commits_then"] = """select cluster, grp, topic, part, snapshot_ms, c_off from (select * from commit_log
       qualify row_number() over (partition by cluster, grp, topic, part, snapshot_ms order by c_off desc, err_code desc) = 1)
       where err_code = 0 and c_off >= 0 and (cluster, grp, snapshot_ms) in (select (cluster, grp, snapshot_ms) from listed_chosen)"""
_CTE["windowed_then"] = f"""select c.*, h.off, max(h.at_ms) as at_ms
       from commits_then c left join samples h on h.cluster = c.cluster and h.topic = c.topic and h.part = c.part
       and h.at_ms <= c.snapshot_ms and h.at_ms >= c.snapshot_ms - {TTL} group by all"""
_CTE["replayed_then"] = """select w.cluster, grp, w.topic, w.part, w.snapshot_ms, c_off, any_value(leo) as leo, any_value(leo_at) as leo_at,
       count(off) as n, max(off) filter (off <= c_off) as lo_off, arg_max(at_ms, off) filter (off <= c_off) as lo_at,
       min(off) filter (off > c_off) as up_off, arg_min(at_ms, off) filter (off > c_off) as up_at
       from windowed_then w left join latest_then l on l.cluster = w.cluster and l.topic = w.topic and l.part = w.part
       and l.snapshot_ms = w.snapshot_ms group by all"""
_CTE["lags_then"] = _lag_select("replayed_then", snapshot="snapshot_ms, ")
_CTE["topics_then"] = f"select cluster, grp, topic, snapshot_ms, {_TOPIC_SUMS} from lags_then group by all"
_CTE["groups_then"] = f"select cluster, grp, snapshot_ms, {_GROUP_SUMS} from lags_then group by all"
_CTE["retained"] = f"""select * from samples qualify at_ms >=
       max(at_ms) over (partition by cluster, topic, part) - {TTL}"""
_CTE["probes"] = """select case when user_id % 10 = 9 then 'store' else concat('c', cast(user_id % 2 as varchar)) end as cluster,
       event_type <> 'error' as ok, epoch_us(ts) // 1000 as at_ms from events"""
_CTE["last_probe"] = """select cluster, ok from probes
       qualify row_number() over (partition by cluster order by at_ms desc, ok) = 1"""
_CTE["last_probe_hour"] = """select at_ms // 3600000 as hour, cluster, ok from probes
       qualify row_number() over (partition by at_ms // 3600000, cluster order by at_ms desc, ok) = 1"""
_CTE["member_events"] = """select cast(user_id as varchar) as member,
       case when event_type = 'error' and event_id % 4 = 0 then 'leave' else 'beat' end as kind,
       epoch_us(ts) // 1000 as at_ms from events"""


def _session_ctes(prefix: str, beats: str) -> None:
    _CTE[f"{prefix}_marked"] = f"""select member, at_ms, case when at_ms - lag(at_ms) over w <= {MEMBER_TTL} then 0 else 1 end as opens
       from ({beats}) window w as (partition by member order by at_ms)"""
    _CTE[f"{prefix}_numbered"] = f"""select member, at_ms,
       sum(opens) over (partition by member order by at_ms rows unbounded preceding) as s from {prefix}_marked"""
    _CTE[f"{prefix}_sessions"] = f"""select member, min(at_ms) as start_ms, max(at_ms) + {MEMBER_TTL} as end_ms, count(*) as beats
       from {prefix}_numbered group by member, s"""


_session_ctes("all", "select * from member_events where kind = 'beat'")
_session_ctes(
    "open",
    """select b.* from member_events b where kind = 'beat' and not exists (select 1 from member_events l
       where l.kind = 'leave' and l.member = b.member and l.at_ms >= b.at_ms)""",
)
_CTE["live"] = """select member, max(start_ms) as first_seen_ms from open_sessions
       where end_ms > (select max(at_ms) from member_events) group by member"""
_CTE["member_events_at"] = """select * from member_events
       where at_ms <= (select (min(at_ms) + max(at_ms)) // 2 from member_events)"""
_session_ctes(
    "at",
    """select b.* from member_events_at b where kind = 'beat' and not exists (select 1 from member_events_at l
       where l.kind = 'leave' and l.member = b.member and l.at_ms >= b.at_ms)""",
)
_CTE["live_at"] = """select member, max(start_ms) as first_seen_ms from at_sessions
       where end_ms > (select (min(at_ms) + max(at_ms)) // 2 from member_events) group by member"""


_CTE["gauges_then"] = _gauge_rows("then")
for _suffix in ("", "_at"):
    _CTE[f"indexed{_suffix}"] = f"select member, row_number() over (order by first_seen_ms, member) - 1 as member_index from live{_suffix}"

_HEALTH = """case when coalesce(bool_or(ok) filter (cluster <> 'store'), false)
            and coalesce(bool_and(ok) filter (cluster = 'store'), false) then 'OK' else 'Unhealthy' end as status,
       coalesce(string_agg(distinct cluster, ',' order by cluster) filter (cluster <> 'store' and not ok), '') as unhealthy_clusters"""

_HELP_OF = "case name " + " ".join(f"when '{name}' then '{text}'" for name, text in HELP.items()) + " end"

# Gauge text: exponent form from one million up; only small numbers have a fraction here.
_NUMBER = """case when value <> floor(value) then cast(value as varchar)
       when abs(value) < 1e6 then cast(cast(value as bigint) as varchar)
       else concat(case when value < 0 then '-' else '' end,
            left(cast(cast(abs(value) as bigint) as varchar), 1),
            case when rtrim(substr(cast(cast(abs(value) as bigint) as varchar), 2), '0') = '' then ''
                 else '.' || rtrim(substr(cast(cast(abs(value) as bigint) as varchar), 2), '0') end,
            'e+', lpad(cast(length(cast(cast(abs(value) as bigint) as varchar)) - 1 as varchar), 2, '0')) end"""

_QUOTED = "regexp_replace(labels, '=([^,]*)', '=\"\\1\"', 'g')"

_LAG_COLS = "c_off, leo, leo_at, lag_off, lag_s, lag_s_case"

_QUERIES: dict[str, str] = {
    "group_filter": "select cluster, grp from filtered",
    "error_rows": """select cluster, grp, 'cluster' as scope,
         case when not has_config then 'no client config' else coalesce(list_error, 'no configuration') end as reason
         from groups join clusters using (cluster)
         where not has_config or list_error is not null or cluster not in (select cluster from rules)
       union all
       select cluster, grp, 'group', error from groups join clusters using (cluster)
         where has_config and list_error is null and error is not null and cluster in (select cluster from rules)""",
    "surviving_groups": "select cluster, grp from surviving",
    "valid_commits": "select * from commits",
    "flatten_groups": f"""select cluster, grp, topic, part, c_off from (
         select {_OWNER.format(k='l_suppkey')}, {_TOPIC} as topic, cast(l_partkey // 20 as integer) as part, l_orderkey as c_off from lineitem
         union all
         select {_OWNER.format(k='l_suppkey')}, {_TOPIC} as topic, cast(l_partkey // 20 + 1 as integer) as part, l_orderkey + 1 as c_off from lineitem
         union all
         select {_OWNER.format(k='l_suppkey')}, {_TOPIC} || '-retry' as topic, cast(l_partkey // 20 as integer) as part, l_orderkey as c_off from lineitem)""",
    "union_of_clusters": "select * from samples where cluster in ('c0', 'c1')",
    "node_assignment": """select cluster, grp, shard, member from (select cluster, grp,
         concat('0x', substr(sha256(grp), 1, 8))::bigint % (select count(*) from live) as shard from groups)
         left join indexed on shard = member_index""",
    "moved_groups": """select * from (select cluster, grp, b.member as member_before, a.member as member_after from groups
         left join indexed_at b on concat('0x', substr(sha256(grp), 1, 8))::bigint % (select count(*) from live_at) = b.member_index
         left join indexed a on concat('0x', substr(sha256(grp), 1, 8))::bigint % (select count(*) from live) = a.member_index)
         where member_before is distinct from member_after""",
    "known_samples": """select cluster, topic, part, max(off) as off, at_ms from (
         select cluster, topic, part, off - back as off, at_ms from samples, (values (0), (1)) b(back) where off % 13 <> 2 and off % 17 <> 3)
         group by all""",
    "groups_checked": "select cluster, count(*) as groups_checked from chosen group by cluster",
    "shard_assign": """select cluster, grp, concat('0x', substr(sha256(grp), 1, 8))::bigint % 7 as shard from groups""",
    "shard_balance": """select concat('0x', substr(sha256(grp), 1, 8))::bigint % 7 as shard, count(*) as groups,
         cast(sum(lag) as bigint) as sum_off
         from (select cluster, grp, sum(greatest(leo - c_off, 0)) as lag from commits join latest using (cluster, topic, part)
               group by cluster, grp) group by all""",
    "leader_load": """select cluster, leader, topic, part // 16 as batch,
         string_agg(cast(part as varchar), ',' order by part) as parts, count(*) as partitions
         from (select distinct cluster, topic, part from commits) join topic_meta using (cluster, topic, part)
         where leader is not null group by all""",
    "partitions_without_leader": """select cluster, topic, part from (select distinct cluster, topic, part from commits)
         left join topic_meta using (cluster, topic, part) where leader is null""",
    "latest_offsets": """select cluster, topic, part, arg_max(off, at_ms) as leo, max(at_ms) as leo_at from samples
         where off % 17 <> 3 and off % 19 <> 4 group by all""",
    "message_log_end": "select cluster, topic, part, max(event_id) + 1 as leo, max(ts_ms) as leo_at from plog group by all",
    "series_key": """select concat(cluster, ':', topic, ':', cast(part as varchar)) as series_key, count(*) as samples
         from samples group by all""",
    "history_compress": """select cluster, topic, part, off, try_cast(max(member) as bigint) as at_ms from
         (select cluster, topic, part, member, max(off) as off from members_raw group by all) group by cluster, topic, part, off""",
    "history_retention": "select * from retained",
    "history_merge": "select cluster, topic, part, off, max(at_ms) as at_ms from retained group by all",
    "flat_run_compaction": """select cluster, topic, part, off, at_ms from (
         select *, lag(off) over w as before, lead(off) over w as after from samples
         window w as (partition by cluster, topic, part order by off, at_ms))
         where before is distinct from off or after is distinct from off""",
    "series_tail": """select *, row_number() over (partition by cluster, topic, part order by off desc, at_ms desc) as rank
         from samples qualify rank <= 2""",
    "offset_lag": """select cluster, grp, topic, part, c_off, leo, greatest(leo - c_off, 0) as lag_off
         from commits join latest using (cluster, topic, part)""",
    "missing_offset_audit": """select cluster, skip_reason, count(*) as partitions from (
         select cluster, case when leo is null and not (c_off >= 0)
                then 'log_end_unknown commit_unknown'
                when leo is null then 'log_end_unknown'
                when c_off < 0 then 'commit_unknown' end as skip_reason
         from committed left join latest using (cluster, topic, part)) where skip_reason is not null group by all""",
    "time_lag": f"select cluster, grp, topic, part, {_LAG_COLS} from lags",
    "time_lag_window": f"select cluster, grp, topic, part, {_LAG_COLS} from lags",
    "time_lag_array": f"select cluster, grp, topic, part, {_LAG_COLS} from lags",
    "lag_with_read_failures": f"select cluster, grp, topic, part, {_LAG_COLS} from read_lags",
    "time_lag_text": f"select cluster, grp, topic, part, {_LAG_COLS} from text_lags",
    "lag_case_profile": """select lag_s_case, count(*) as partitions, max(lag_s) as max_lag_s from lags
         where leo is not null group by all""",
    "lag_replay": f"select cluster, grp, topic, part, snapshot_ms, {_LAG_COLS} from replay_lags",
    "topic_rollup": f"select cluster, grp, topic, {_TOPIC_SUMS} from lags group by all",
    "group_rollup": f"select cluster, grp, {_GROUP_SUMS} from lags group by all",
    "lag_grouping_sets": f"""select cluster, grp, topic, 0 as is_group, {_TOPIC_SUMS} from lags group by cluster, grp, topic
         union all select cluster, grp, null, 1, {_GROUP_SUMS} from lags group by cluster, grp""",
    "group_summary": f"select cluster, grp, {_GROUP_SUMS}, count(distinct topic) as topics from lags group by cluster, grp",
    "group_topic_names": """select cluster, grp, line, string_agg(topic, ', ' order by topic) as names from
         (select *, concat('0x', substr(sha256(topic), 1, 8))::bigint
                    % cast(ceil(count(*) over (partition by cluster, grp) / 3) as bigint) as line
          from (select distinct cluster, grp, topic from commits)) group by cluster, grp, line""",
    "group_lag_report": """select cluster, grp, max_off, max_s, sum_off, sum_s
         from chosen left join group_level using (cluster, grp)""",
    "backlog_gauges": "select name, labels, value, at_ms from gauges_then",
    "gauge_long": "select name, labels, value from extra_gauges",
    "exposition_lines": f"""select name, 2 as seq, {_QUOTED} as labels,
         concat(name, case when labels = '' then '' else concat('{{', {_QUOTED}, '}}') end, ' ', {_NUMBER}) as line from gauges
         union all select distinct name, 0, '', concat('# HELP ', name, ' ', {_HELP_OF}) from gauges
         union all select distinct name, 1, '', concat('# TYPE ', name, ' gauge') from gauges""",
    "timeseries_rows": """select concat('__name__=', name, case when labels = '' then '' else ',' || labels end) as labels, value,
         (1704067261789 + cast(floor(value) as bigint) * 977) // 1000 * 1000 as timestamp_ms from gauges""",
    "gauge_last_value": """select name, labels, arg_max(value, at_ms) as value, max(at_ms) as at_ms
         from replay_gauges group by name, labels""",
    "iteration_time": "select * from iterations",
    "health_rollup": f"select {_HEALTH} from last_probe",
    "health_by_hour": f"select hour, {_HEALTH} from last_probe_hour group by hour",
    "member_sessions": "select member, start_ms, end_ms, beats from all_sessions",
    "newest_commits": "select cluster, grp, topic, part, c_off, err_code, snapshot_ms from committed",
    "member_index_at": """select member, row_number() over (order by first_seen_ms, member) - 1 as member_index,
         count(*) over () as members from live_at""",
    "member_index": """select member, row_number() over (order by first_seen_ms, member) - 1 as member_index,
         count(*) over () as members from live""",
}


def _needed(sql: str) -> list[str]:
    """CTEs used by ``sql``, in definition order of their dependencies."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in _CTE:
            if name not in found and re.search(rf"\b(from|join)\s+{name}\b", text):
                visit(_CTE[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def sql_texts() -> dict[str, str]:
    out = {}
    for name, body in _QUERIES.items():
        ctes = ", ".join(f"{c} as ({_CTE[c]})" for c in _needed(body))
        out[name] = f"with {ctes} {body}" if ctes else body
    return out
