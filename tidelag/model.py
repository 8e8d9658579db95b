"""Column keys and schemas shared by every operator.

A *series* is one partition of one topic in one cluster; its log-end offset is
sampled over time.  A *fact* is one consumer group's position in one series.
Unknown offsets, times and lags are NULL throughout.
"""

from pyspark.sql import types as T

SERIES = ["cluster", "topic", "part"]
GROUP = ["cluster", "grp"]
TOPIC = ["cluster", "grp", "topic"]
FACT = ["cluster", "grp", "topic", "part"]

# An offset slice spans 2**SLICE_BITS consecutive offsets of one series.  After
# duplicates are merged a slice holds at most one row per offset, so this is a
# hard upper bound on the samples in any sort group of the nearest-sample lookup.
SLICE_BITS = 20

# A slice looked up more often than this is split over several sort groups.
HOT_ROWS = 1_000_000

# At most so many slices are split: with more lookups, a slice must hold a larger share of them to count as hot.
MAX_HOT_SLICES = 10_000

# Slices whose samples are folded into one array value are kept much narrower,
# since every lookup reads its whole array.
ARRAY_SLICE_BITS = 8

DEFAULT_TTL_SECONDS = 7200
DEFAULT_INTERVAL = "30 seconds"

SAMPLES = T.StructType(
    [
        T.StructField("cluster", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("off", T.LongType()),
        T.StructField("at_ms", T.LongType()),
    ]
)

COMMITS = T.StructType(
    [
        T.StructField("cluster", T.StringType()),
        T.StructField("grp", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("c_off", T.LongType()),
        T.StructField("err_code", T.IntegerType()),
        T.StructField("snapshot_ms", T.LongType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("value", T.DoubleType()),
        T.StructField("at_ms", T.LongType()),
    ]
)
