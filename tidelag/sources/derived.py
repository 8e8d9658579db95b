"""Lag tables derived from the general test tables.

``events`` are taken as the messages of a log: a user belongs to one series of
each event type, and every event stands for ``floor(value) + 1`` messages.
``lineitem`` rows are commits of a group named after the supplier.  All of it is
integer arithmetic, so another engine derives the same rows, and the number of
series, groups and commits grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.functions import epoch_ms
from tidelag.model import FACT, SERIES
from tidelag.sources.tables import read_table

TICK_MS = 21600000  # samples are taken every six hours
FIRST_TICK = 78892  # 2024-01-01, the first day of events
RETENTION_SECONDS = 604800
MEMBER_TTL_MS = 43200000

EPOCH_MS = epoch_ms("ts")
TOPIC_OF_LINE = "element_at(array('click', 'error', 'purchase', 'signup', 'view'), l_linenumber % 5 + 1)"


class DerivedTables:
    """Lazily derived inputs over one directory of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def _read(self, name: str) -> DataFrame:
        return read_table(self.spark, self.dir, name)

    # -- produced side -----------------------------------------------------

    def plog(self) -> DataFrame:
        return self._read("events").selectExpr(
            "concat('c', user_id % 2) as cluster",
            "event_type as topic",
            "cast(user_id div 2 as int) as part",
            f"{EPOCH_MS} as ts_ms",
            "cast(floor(value) as bigint) + 1 as qty",
            "event_id",
        )

    def offset_samples(self) -> DataFrame:
        """Log-end offsets at every tick between the first and last event of a series.

        Events fold to one row per series and tick before the running total,
        whose groups are thus bounded by the time range, not by the events.
        """
        ticks = (
            self.plog()
            .selectExpr(*SERIES, f"ts_ms div {TICK_MS} + 1 as h", "qty")
            .groupBy(*SERIES, "h")
            .agg(F.sum("qty").alias("qty"))
        )
        over = "over (partition by cluster, topic, part order by h)"
        runs = ticks.selectExpr(*SERIES, "h", f"sum(qty) {over} as off", f"lead(h) {over} as next_h")
        return runs.selectExpr(
            *SERIES, "off", "explode(sequence(h, coalesce(next_h - 1, h))) as tick"
        ).selectExpr(*SERIES, "off", f"tick * {TICK_MS} as at_ms")

    def raw_members(self) -> DataFrame:
        """Samples as stored text, with same-time replacements and some malformed times."""
        member = "if(off % 97 = 5, concat('x', at_ms), string(at_ms)) as member"
        return (
            self.offset_samples()
            .selectExpr(*SERIES, "off", member, "explode(array(0, 1)) as back")
            .selectExpr(*SERIES, "off - back as off", "member")
        )

    def offset_responses(self) -> DataFrame:
        """Offset replies with an error code and a list of offsets, some failed or empty."""
        return self.offset_samples().selectExpr(
            *SERIES,
            "at_ms",
            "if(off % 17 = 3, 6, 0) as err_code",
            "if(off % 19 = 4, cast(array() as array<bigint>), array(off)) as offsets",
        )

    def unsure_samples(self) -> DataFrame:
        """Samples of which some lack the offset, some the time, and some come twice."""
        return (
            self.offset_samples()
            .selectExpr(*SERIES, "if(off % 13 = 2, null, off) as off", "if(off % 17 = 3, null, at_ms) as at_ms", "explode(array(0, 1)) as back")
            .selectExpr(*SERIES, "off - back as off", "at_ms")
        )

    def messages(self) -> DataFrame:
        return self.plog().selectExpr(*SERIES, "event_id as offset", "ts_ms as at_ms")

    def topic_meta(self) -> DataFrame:
        series = self.plog().select(*SERIES).distinct()
        return series.selectExpr("*", "if(part % 11 = 10, null, (length(topic) + part) % 7) as leader")

    # -- consumed side -----------------------------------------------------

    @staticmethod
    def _owner(key: str) -> list[str]:
        """Cluster and group of a supplier key."""
        return [
            f"case {key} % 19 when 5 then 'c9' when 6 then 'c8' else concat('c', {key} % 2) end as cluster",
            f"concat('grp-', {key}) as grp",
        ]

    def commit_log(self) -> DataFrame:
        """Every commit with its snapshot; ``seq`` orders the commits of one position."""
        return self._read("lineitem").selectExpr(
            *self._owner("l_suppkey"),
            f"{TOPIC_OF_LINE} as topic",
            "cast(l_partkey div 20 as int) as part",
            "if(l_suppkey % 17 = 3 or l_partkey % 31 = 5, -1L, (l_orderkey * 7 + l_partkey * 13) % 900) as c_off",
            "if(l_orderkey % 13 = 6, 3, 0) as err_code",
            f"(l_orderkey % 124 + {FIRST_TICK}) * {TICK_MS} as snapshot_ms",
            "(snapshot_ms * 1024 + c_off + 1) * 4 + err_code as seq",
        )

    def committed(self) -> DataFrame:
        """The newest commit of every position."""
        newest = [f"max_by({c}, seq) as {c}" for c in ("c_off", "err_code")]
        return (
            self.commit_log()
            .groupBy(*FACT)
            .agg(*[F.expr(e) for e in newest], F.max("snapshot_ms").alias("snapshot_ms"))
        )

    def commit_snapshots(self) -> DataFrame:
        """Valid commits, one per position and snapshot."""
        return (
            self.commit_log()
            .where("err_code = 0 and c_off >= 0")
            .groupBy(*FACT, "snapshot_ms")
            .agg(F.max("c_off").alias("c_off"))
        )

    def iteration_groups(self) -> DataFrame:
        """Groups as every iteration lists them; what fails in one may be well in the next."""
        lines = self._read("lineitem").selectExpr(
            *self._owner("l_suppkey"),
            "l_suppkey",
            f"(l_orderkey % 124 + {FIRST_TICK}) * {TICK_MS} as snapshot_ms",
        )
        error = f"if((l_suppkey + snapshot_ms div {TICK_MS}) % 23 = 7, 'offset fetch failed', null) as error"
        return lines.distinct().selectExpr("cluster", "grp", error, "snapshot_ms")

    def group_payloads(self) -> DataFrame:
        """Nested commit messages: two topics and three partitions per line item."""
        lines = self._read("lineitem").selectExpr(
            *self._owner("l_suppkey"),
            f"{TOPIC_OF_LINE} as topic",
            "cast(l_partkey div 20 as int) as part",
            "l_orderkey as c_off",
        )
        return lines.selectExpr(
            "cluster",
            "grp",
            """array(
                struct(topic, array(struct(part, c_off), struct(part + 1 as part, c_off + 1 as c_off)) as partitions),
                struct(concat(topic, '-retry') as topic, array(struct(part, c_off)) as partitions)) as topics""",
        )

    def groups(self) -> DataFrame:
        return self._read("supplier").selectExpr(
            *self._owner("s_suppkey"),
            "case when s_suppkey % 23 = 7 then 'offset fetch failed'"
            " when s_suppkey % 29 = 11 then 'topic description failed' end as error",
        )

    def clusters(self) -> DataFrame:
        return self.groups().select("cluster").distinct().selectExpr(
            "cluster",
            "true as has_client",
            "cluster <> 'c9' as has_config",
            "if(cluster = 'c8', 'group listing failed', null) as list_error",
        )

    def rules(self) -> DataFrame:
        """Filter rules per cluster; c0 sets both lists, c9 has no rules."""
        return self.spark.sql(
            "select * from values ('c0', '[0246]$', '4$'), ('c1', cast(null as string), '1$'),"
            " ('c8', '', '') as t(cluster, whitelist, blacklist)"
        )

    # -- members and probes --------------------------------------------------

    def probe_log(self) -> DataFrame:
        return self._read("events").selectExpr(
            "if(user_id % 10 = 9, 'store', concat('c', user_id % 2)) as cluster",
            "event_type <> 'error' as ok",
            f"{EPOCH_MS} as at_ms",
        )

    def member_events(self) -> DataFrame:
        return self._read("events").selectExpr(
            "string(user_id) as member",
            "if(event_type = 'error' and event_id % 4 = 0, 'leave', 'beat') as kind",
            f"{EPOCH_MS} as at_ms",
        )

    def run_log(self) -> DataFrame:
        """Stage records of iterations: one iteration per tick."""
        return self.plog().selectExpr(f"ts_ms div {TICK_MS} as iteration", "ts_ms as at_ms")
