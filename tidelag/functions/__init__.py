from tidelag.functions.lagmath import LAG_CASE, LAG_OFFSETS, LAG_SECONDS
from tidelag.functions.text import gauge_text, label_text, merge_labels, series_key
from tidelag.functions.values import epoch_ms, int_div, shard_of

__all__ = [
    "LAG_CASE",
    "LAG_OFFSETS",
    "LAG_SECONDS",
    "epoch_ms",
    "gauge_text",
    "int_div",
    "label_text",
    "merge_labels",
    "series_key",
    "shard_of",
]
