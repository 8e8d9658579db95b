"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

A bin carries bitmaps of the sources and of the duplicate clusters in it: it takes at most ``per_source`` documents of
one source and at most one of a cluster.  Documents go in order of falling length; the open bins are kept in order
of their residual, and the search walks from the tightest bin that can hold the document to ever larger residuals
until a bin without a conflict is found; without one, a new bin is opened.

Documents are dealt to shards of about ``shard_documents`` by hash, whatever their source or cluster, and each shard
is packed by one task, so no task grows with the data or with a hot source.  Equal rows are counted and their copies
numbered before, and the number is part of the hash.  A document longer than a bin is cut
into pieces: full pieces fill bins of their own, the rest is packed like any document.

Clusters are the near-duplicate groups of ``minmax_dedup``; ``measured`` takes equal texts alone at the caller's choice.

Defined results: a NULL text has only its end id, and so has an empty one; texts without a word are in no cluster
(of equal texts: empty ones); a NULL
source is a source of its own; NULL ids are packed too; repeated rows are packed each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.llm import minmax_dedup
from tidelag.llm.common import numbered, shared_dir, written

CAPACITY = 16_384
PER_SOURCE = 2
SHARD_DOCUMENTS = 2_048

SCHEMA = "bin_id long, slot int, doc_id long, piece int, start long, length long, fill long"


def best_fit(
    items: list[tuple[int, object, object]], capacity: int, per_source: int
) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """Pack (length, source, cluster or None) items; lengths are at least 1.

    Returns the bins as lists of (item, start in the item, length), and what each bin holds.
    """
    bins: list[list[tuple[int, int, int]]] = []
    filled: list[int] = []
    source_maps: list[list[int]] = []  # per bin one bitmap per admitted document of a source
    cluster_maps: list[int] = []
    source_bit: dict[object, int] = {}
    cluster_bit: dict[object, int] = {}
    open_bins: list[tuple[int, int]] = []  # (residual, bin) in order

    rest = []
    for i, (length, _, _) in enumerate(items):
        for start in range(0, length - capacity + 1, capacity):
            bins.append([(i, start, capacity)])
            filled.append(capacity)
            source_maps.append([])
            cluster_maps.append(0)
        if length % capacity:
            rest.append((length % capacity, i))
    for size, i in sorted(rest, key=lambda r: (-r[0], r[1])):
        length, source, cluster = items[i]
        own_source = 1 << source_bit.setdefault(source, len(source_bit))
        own_cluster = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            chosen = open_bins[at][1]
            if not cluster_maps[chosen] & own_cluster and not source_maps[chosen][-1] & own_source:
                residual = open_bins.pop(at)[0] - size
                break
            at += 1
        else:
            chosen, residual = len(bins), capacity - size
            bins.append([])
            filled.append(0)
            source_maps.append([0] * per_source)
            cluster_maps.append(0)
        bins[chosen].append((i, length - size, size))
        filled[chosen] += size
        cluster_maps[chosen] |= own_cluster
        maps = source_maps[chosen]
        for n in range(per_source):  # the last map marks sources that the bin has taken up
            if not maps[n] & own_source:
                maps[n] |= own_source
                break
        if residual:
            insort(open_bins, (residual, chosen))
    return bins, filled


def _copies(table: DataFrame) -> DataFrame:
    """``table`` with ``copy``, which numbers equal rows from 0.  Counts combine before the shuffle."""
    counted = table.groupBy(*table.columns).agg(F.count(F.lit(1)).alias("n"))
    # in two steps, so that no array holds all the numbers of a row repeated millions of times
    step = F.lit(4096)
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))))
    first = F.col("run") * step
    return runs.select(*table.columns, F.explode(F.sequence(first, F.least(first + step, F.col("n")) - 1)).alias("copy"))


def pack(
    documents: DataFrame,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    shard_documents: int = SHARD_DOCUMENTS,
) -> DataFrame:
    """Rows of ``SCHEMA`` for ``documents`` (doc_id, source, cluster, length)."""
    if capacity < 1 or per_source < 1:
        raise ValueError("capacity and per_source must be at least 1")
    shards = max(1, -(-documents.count() // shard_documents))
    table = documents.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        F.col("cluster").cast("long"),
        F.col("length").cast("long"),
    )
    table = _copies(table).withColumn("shard", F.pmod(F.xxhash64(*table.columns, "copy"), F.lit(shards)))

    def run(rows: pa.Table) -> pa.Table:
        by = ["doc_id", "length", "cluster", "source", "copy"]
        rows = rows.sort_by([(c, "ascending") for c in by])
        ids = rows.column("doc_id").to_pylist()
        items = list(zip(*(rows.column(c).to_pylist() for c in ("length", "source", "cluster")), strict=True))
        bins, filled = best_fit(items, capacity, per_source)
        first = rows.column("shard")[0].as_py() << 32
        out = [
            (first + b, slot, ids[i], start // capacity, start, length, filled[b])
            for b, held in enumerate(bins)
            for slot, (i, start, length) in enumerate(held)
        ]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = zip(*out, strict=True)
        names = ["bin_id", "slot", "doc_id", "piece", "start", "length", "fill"]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return table.groupBy("shard").applyInArrow(run, SCHEMA)


def measured(documents: DataFrame, near: bool = True, folder: str | None = None) -> DataFrame:
    """(doc_id, source, cluster, length) of texts: bytes and one end id; near copies, or else equal texts, are one cluster."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0))
    told = ["doc_id", "source", F.when(size > 0, F.xxhash64(text)).alias("cluster"), (size + 1).alias("length")]
    if not near:
        return documents.select(*told)
    folder = folder or shared_dir(documents.sparkSession)
    # rows are judged by their own text, also where ids are NULL or repeat
    rows = numbered(documents.select("doc_id", "source", "text"), folder)
    found = minmax_dedup.dedup(rows.select(F.col("__row").alias("doc_id"), "text"), folder)
    clusters = found.where("n_shingles > 0").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("cluster"))
    joined = rows.select(*told, "__row").drop("cluster").join(clusters, "__row", "left")
    return written(joined.select("doc_id", "source", "cluster", "length"), folder, "measured")
