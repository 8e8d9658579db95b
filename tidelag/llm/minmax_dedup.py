"""Near-duplicate documents by min-max hashing.

Each of ``PERMUTATIONS`` hash evaluations of a document's 4-word shingles keeps both its least and its greatest
value, so 64 evaluations give a signature of 128 values.  Bands of four values propose candidates; links are
confirmed on full shingle sets.

1. One pass over the texts: set size, a 128-bit key of the set, band values.  Documents with equal sets form a
   class at once; only the least id of a class goes on, so thousands of copies cost one row.
2. Documents that share a band value are joined to the least id of that value (a star, not all pairs), and the
   connected components of those stars are the *candidate groups*.
3. A group is cut into cells of bounded weight by set size and hash.  Cells of neighbouring sizes meet in one
   task each, where bitmaps of the shared shingles give exact intersections.  A task returns a spanning set of the
   confirmed links, so it emits fewer rows than it has documents.
4. Components of the confirmed links are the result.

A pair of similarity 0.8 misses all 32 bands with a probability of about 5e-8.

Defined results: NULL or empty texts have the empty set and are linked with nothing; fewer than four words make
one shingle; a row with a NULL id takes no part, is kept and has a NULL component; rows that repeat an id are
judged with that id.  An empty table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.llm import textkernel as K
from tidelag.llm.common import shared_dir, written
from tidelag.llm.components import components

SHINGLE = 4
PERMUTATIONS = 64
BAND_ROWS = 4
BANDS = 2 * PERMUTATIONS // BAND_ROWS
CELL_SHINGLES = 400_000  # expected weight of a cell: bounds the memory of a task whatever the group's size
CELL_DOCUMENTS = 1_000

_MULTIPLIERS = K.randoms(PERMUTATIONS, 2) | np.uint64(1)
_SHIFTS = K.randoms(PERMUTATIONS, 3)
_FOLDS = K.randoms(BAND_ROWS, 4) | np.uint64(1)

FEATURES = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>"


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for runs of rows."""
    for row, raw, offsets in K.slices(column):
        words = K.words(raw, offsets, K.SPACED)
        counts = words.counts
        grams = words.grams(SHINGLE)
        sets = []
        for first, n in zip(words.first[:-1].tolist(), counts.tolist(), strict=True):
            if n >= SHINGLE:
                sets.append(np.unique(grams[first : first + n - SHINGLE + 1]))
            elif n:
                whole = K.Words(np.array([0, n]), words.hashes[first : first + n]).grams(n)[:1]
                sets.append(whole)
            else:
                sets.append(np.empty(0, np.uint64))
        yield row, sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Band values (documents x BANDS) of non-empty sets.  A band holds minimum and maximum of two permutations."""
    hashes = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    values = np.empty((2 * PERMUTATIONS, len(sets)), dtype=np.uint64)
    for p in range(PERMUTATIONS):
        permuted = hashes * _MULTIPLIERS[p] + _SHIFTS[p]
        values[2 * p] = np.minimum.reduceat(permuted, starts)
        values[2 * p + 1] = np.maximum.reduceat(permuted, starts)
    bands = values.reshape(BANDS, BAND_ROWS, len(sets))
    return K.mix((bands * _FOLDS[None, :, None]).sum(axis=1, dtype=np.uint64)).T


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, sets in shingle_sets(batch.column("text")):
            filled = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            if filled:
                for i, values in zip(filled, signatures([sets[i] for i in filled]).view(np.int64), strict=True):
                    bands[i] = values
            keys = [[int(K.mix(s ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) for s in sets] for salt in (17, 71)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(row, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys[0], pa.int64()),
                    pa.array(keys[1], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "key_a", "key_b", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, sets in shingle_sets(batch.column("text")):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["doc_id", "shingles"],
            )


def spanning_links(
    ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int = 80
) -> list[tuple[int, int]]:
    """A spanning set of the exact links among documents; those of two different sides only, if there are two."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((ids, side))
    shingles, where = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(where, minlength=len(shingles)) > 1
    column = np.cumsum(shared) - 1
    bits = np.zeros((n, (int(shared.sum()) + 63) // 64), dtype=np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    inside = shared[where]
    place = column[where[inside]]
    np.bitwise_or.at(bits, (owner[inside], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    two_sides = side.min() != side.max()
    group = np.arange(n)
    links = []
    for at, i in enumerate(order):
        rest = order[at + 1 :]
        fits = (group[rest] != group[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))
        if two_sides:
            fits &= side[rest] != side[i]
        rest = rest[fits]
        if not len(rest):
            continue
        both = np.bitwise_count(bits[rest] & bits[i]).sum(axis=1, dtype=np.int64)
        for j in rest[100 * both >= percent * (sizes[rest] + sizes[i] - both)]:
            if group[j] != group[i]:
                links.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return links


def _confirm(table: pa.Table) -> pa.Table:
    ids = table.column("doc_id").to_numpy()
    side = table.column("side").to_numpy()
    sets = [np.frombuffer(s, dtype=np.uint64) for s in table.column("shingles").to_pylist()]
    links = spanning_links(ids, side, sets)
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _tasks(members: DataFrame) -> DataFrame:
    """(group, cell, task, side): which tasks each cell of each candidate group joins.

    ``members`` has (group, level, n_shingles).  A level spans a factor of 1.25 in set size, so documents that
    can be similar lie in the same level or in neighbouring ones.
    """
    levels = members.groupBy("group", "level").agg(
        F.greatest(
            F.ceil(F.sum("n_shingles") / CELL_SHINGLES), F.ceil(F.count(F.lit(1)) / CELL_DOCUMENTS)
        ).alias("parts")
    )
    near = levels.select("group", F.explode(F.sequence(F.col("level"), F.col("level") + 1)).alias("level"), F.col("level").alias("own"), "parts")
    upper = near.where("own < level").select("group", "level", F.col("own").alias("low"), F.col("parts").alias("low_parts"))
    cross = (
        levels.join(upper, ["group", "level"])
        .select("group", "low", "level", F.explode(F.sequence(F.lit(1).cast("long"), "low_parts")).alias("i"), "parts")
        .select("group", "low", "i", "level", F.explode(F.sequence(F.lit(1).cast("long"), "parts")).alias("j"))
    )
    same = (
        levels.select("group", "level", F.explode(F.sequence(F.lit(1).cast("long"), "parts")).alias("i"), "parts")
        .select("group", F.col("level").alias("low"), "i", "level", F.explode(F.sequence("i", "parts")).alias("j"))
    )
    pairs = cross.unionByName(same).withColumn("task", F.xxhash64("group", "low", "i", "level", "j"))
    first = pairs.select("group", F.col("low").alias("level"), F.col("i").alias("part"), "task", F.lit(0).alias("side"))
    second = pairs.where("low <> level or i <> j").select("group", "level", F.col("j").alias("part"), "task", F.lit(1).alias("side"))
    return first.unionByName(second), levels


def dedup(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``documents`` (columns doc_id, text)."""
    folder = folder or shared_dir(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    features = written(docs.mapInArrow(_features, FEATURES), folder, "features")
    key = ["key_a", "key_b", "n_shingles"]
    classes = features.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    reps = features.join(classes, key).where("doc_id = rep").select("doc_id", "n_shingles", "bands")
    banded = reps.select("doc_id", F.posexplode("bands").alias("band", "value")).select(
        "doc_id", F.xxhash64("band", "value").alias("bucket")
    )
    # a partial aggregate: one row per bucket and task leaves the map side, however hot the bucket
    hubs = banded.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("most")).where("hub < most")
    stars = (
        banded.join(hubs.select("bucket", "hub").hint("rebalance"), "bucket")
        .where("doc_id <> hub")
        .select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
        .distinct()
    )
    groups = components(stars, folder, "candidates")
    members = written(
        groups.join(reps.select(F.col("doc_id").alias("id"), "n_shingles").distinct(), "id").select(
            "id",
            F.col("component").alias("group"),
            "n_shingles",
            F.floor(F.log("n_shingles") / F.log(F.lit(1.25))).alias("level"),
        ),
        folder,
        "members",
    )
    weights = members.groupBy("group").agg(F.sum("n_shingles").alias("weight"), F.count(F.lit(1)).alias("size"))
    small = f"weight <= {CELL_SHINGLES} and size <= {CELL_DOCUMENTS}"
    sized = members.join(weights.hint("rebalance"), "group")
    whole = sized.where(small).select("id", F.col("group").alias("task"), F.lit(0).alias("side"))
    large = sized.where(f"not ({small})").select("id", "group", "level", "n_shingles")
    tasks, levels = _tasks(large)
    placed = large.join(levels.hint("rebalance"), ["group", "level"]).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")) + 1
    )
    split = placed.join(tasks.hint("rebalance"), ["group", "level", "part"]).select("id", "task", "side")
    work = written(whole.unionByName(split), folder, "work")
    chosen = docs.join(members.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    sets = chosen.mapInArrow(_sets, "doc_id long, shingles binary").dropDuplicates(["doc_id"])
    links = (
        work.join(sets, work.id == sets.doc_id)
        .select("task", "doc_id", "side", "shingles")
        .groupBy("task")
        .applyInArrow(_confirm, "a long, b long")
    )
    joined = components(written(links, folder, "links"), folder, "linked")
    of_class = classes.join(joined, F.col("rep") == F.col("id"), "left").select(
        *key, F.coalesce("component", "rep").alias("of_class")
    )
    found = features.select("doc_id", *key).join(of_class.hint("rebalance"), key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
