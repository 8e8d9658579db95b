"""Text forms of keys, labels and gauge values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def series_key(cluster="cluster", topic="topic", part="part") -> Column:
    return F.concat_ws(":", F.col(cluster), F.col(topic), F.col(part).cast("string"))


def merge_labels(*maps: Column) -> Column:
    """Merge label maps; on a shared key the later map wins."""

    def pair(left: Column, right: Column) -> Column:
        return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)

    return reduce(pair, maps)


def _escaped(text: Column) -> Column:
    # Label values of the text format escape backslash, newline and quote.
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def label_text(labels: Column, quote: bool = True) -> Column:
    """``a="1",b="2"`` in label-name order (``a=1,b=2`` without quoting)."""
    entries = F.array_sort(F.map_entries(labels))
    if quote:
        one = lambda e: F.concat(e["key"], F.lit('="'), _escaped(e["value"]), F.lit('"'))
    else:
        one = lambda e: F.concat(e["key"], F.lit("="), e["value"])
    return F.array_join(F.transform(entries, one), ",")


def gauge_text(value: Column) -> Column:
    """Shortest decimal text of a gauge; exponent form below 1e-4 and from 1e6 up."""
    plain = value.cast("string")
    size = F.abs(value)
    sign = F.when(value < 0, "-").otherwise("")

    def scientific(digits: Column, exponent: Column) -> Column:
        digits = F.regexp_replace(digits, "0+$", "")
        tail = F.substring(digits, 2, 400)
        mantissa = F.concat(F.substring(digits, 1, 1), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""))
        width = F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2))
        power = F.lpad(F.abs(exponent).cast("string"), width, F.lit("0"))
        return F.concat(sign, mantissa, F.when(exponent < 0, "e-").otherwise("e+"), power)

    mantissa_digits = F.regexp_replace(F.substring_index(plain, "E", 1), "[.-]", "")
    all_digits = F.regexp_replace(plain, "[.-]", "")
    return (
        F.when(F.isnan(value), "NaN")
        .when(size == float("inf"), F.concat(F.when(value < 0, "-").otherwise("+"), F.lit("Inf")))
        .when(value == 0, "0")
        .when(
            (size >= 1e7) | (size < 1e-4),
            scientific(mantissa_digits, F.substring_index(plain, "E", -1).try_cast("int")),
        )
        .when(size >= 1e6, scientific(all_digits, F.lit(6)))
        .when(size < 1e-3, F.regexp_replace(value.cast("decimal(38,20)").cast("string"), "0+$", ""))
        .otherwise(F.regexp_replace(plain, r"\.0$", ""))
    )
