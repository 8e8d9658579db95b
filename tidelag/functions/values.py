"""Small scalar helpers built from JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(a: Column | str, b: Column | str) -> Column:
    """Integer division truncating toward zero."""
    return F.call_function("div", _col(a), _col(b))


def epoch_ms(ts: str) -> str:
    """SQL for the epoch milliseconds of a TIMESTAMP_NTZ read as UTC, whatever the session time zone."""
    return (
        f"(date_diff(to_date({ts}), date'1970-01-01') * 86400000L + hour({ts}) * 3600000L"
        f" + minute({ts}) * 60000L + cast(extract(second from {ts}) * 1000 as bigint))"
    )


def shard_of(grp: Column | str, shards: int | Column) -> Column:
    """Stable shard of a group: the first 32 bits of SHA-256(name), modulo ``shards``; NULL if there are none."""
    shards = shards if isinstance(shards, Column) else F.lit(shards)
    head = F.substring(F.sha2(_col(grp).cast("binary"), 256), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("bigint"), shards.cast("bigint"))
