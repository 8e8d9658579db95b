"""Benchmark decontamination by winnowing.

Every window of ``WINDOW`` words selects the least hash among its runs of ``GRAM`` words, the last of equal ones; the
distinct (position, hash) points are the fingerprints of a text.  Equal windows select the same run at the same place,
so every shared span of at least ``WINDOW`` words has a fingerprint in common.

1. Benchmark items give their points, each with the ``REACH`` words before and after it.  A bitmap marks their
   hashes; it may let strangers through but misses nothing, and it never exceeds 64 MB.
2. One pass over the documents selects points alike and emits those that the bitmap marks.
3. Points are joined on the fingerprint and each hit is extended, word by word, to both sides.  Spans of at least
   ``WINDOW`` words are what a document and an item have in common; a window that holds a point lies within its reach.

An item of fewer words than a window is one shorter window, looked up whole by its own length.

Defined results: NULL or empty texts have no words; equal rows get equal results, and rows that share an id but not
the text are judged each by its own text; items with a NULL id still hit words but are not counted or named; an
empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelag.llm import textkernel as K
from tidelag.llm.common import shared_dir, wide_row_key, written

WINDOW = 10
GRAM = 8  # long runs are rare by chance, so a fingerprint meets few strangers
REACH = WINDOW - GRAM
BITMAP_BITS = (1 << 20, 1 << 29)  # least and greatest size of the bitmap; between them 16 bits a fingerprint
BROADCAST_ROWS = 500_000  # keys of hit rows, 32 characters each, that are broadcast at most

_POINT = "need int, fp long, before array<long>, after array<long>"
_FOUND = "array<struct<start:int,need:int,fp:long,before:array<long>,after:array<long>>>"


def _runs(words: K.Words, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` words from each ``start`` on; for GRAM those of ``Words.grams``."""
    folded = np.full(len(start), length, dtype=np.uint64) * K._STEP
    for i in range(length):
        folded = folded * K._FOLD + words.hashes[start + i]
    return K.mix(folded)


def points(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(words at which the selected runs begin, rising; hashes of the runs)."""
    grams = words.grams(GRAM)
    start = np.flatnonzero(words.room(WINDOW))
    least, chosen = grams[start], start
    for i in range(1, REACH + 1):
        other = grams[start + i]
        chosen = np.where(other <= least, start + i, chosen)
        least = np.minimum(least, other)
    selected = np.zeros(len(grams), dtype=bool)
    selected[chosen] = True
    at = np.flatnonzero(selected)
    return at, grams[at]


def _lists(values: np.ndarray, there: np.ndarray) -> pa.ListArray:
    """Rows of ``values`` as lists of the entries that are ``there``."""
    bounds = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values[there].view(np.int64)))


def _around(words: K.Words, at: np.ndarray, reach: np.ndarray) -> list[pa.ListArray]:
    """Hashes of up to ``reach`` words of the same text before and after the runs at ``at``, the nearest first."""
    owner = np.searchsorted(words.first, at, side="right") - 1
    step = np.arange(REACH)[None, :]
    own = step < reach[:, None]
    before, after = at[:, None] - 1 - step, at[:, None] + GRAM + step
    sides = []
    for place, there in ((before, before >= words.first[owner][:, None]), (after, after < words.first[owner + 1][:, None])):
        there &= own
        sides.append(_lists(words.hashes[np.where(there, place, 0)] if len(words.hashes) else np.zeros(place.shape, np.uint64), there))
    return sides


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("item_id")
        for row, raw, offsets in K.slices(batch.column("text")):
            words = K.words(raw, offsets, K.ALNUM)
            at, fps = points(words)
            starts, hashes = [at], [fps]
            needs = [np.full(len(at), WINDOW)]
            for item in np.flatnonzero((words.counts > 0) & (words.counts < WINDOW)).tolist():
                n = int(words.counts[item])
                starts.append(words.first[item : item + 1])
                hashes.append(_runs(words, words.first[item : item + 1], n))
                needs.append(np.array([n]))
            at, need = np.concatenate(starts), np.concatenate(needs)
            owner = np.searchsorted(words.first, at, side="right") - 1
            before, after = _around(words, at, np.where(need == WINDOW, REACH, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(owner + row)),
                    pa.array(need.astype(np.int32)),
                    pa.array(np.concatenate(hashes).view(np.int64)),
                    before,
                    after,
                ],
                names=["item_id", "need", "fp", "before", "after"],
            )


def benchmark_points(benchmark: DataFrame) -> DataFrame:
    """(item_id, need, fp, before, after, place): every fingerprint of every item with the words around it, once.

    ``need`` is how many words a hit must have in common; ``place`` names a fingerprint with its surroundings.
    """
    table = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    found = table.mapInArrow(_items, f"item_id string, {_POINT}").distinct()
    name = F.concat_ws("|", "need", "fp", F.concat_ws(",", F.col("before").cast("array<string>")), F.concat_ws(",", F.col("after").cast("array<string>")))
    return found.withColumn("place", F.md5(name.cast("binary")))


def _bitmap(marks: DataFrame) -> np.ndarray:
    """Flags of the benchmark's fingerprints, as bytes; at most BITMAP_BITS[1] / 32768 rows come back."""
    distinct = marks.agg(F.approx_count_distinct("fp")).first()[0]
    least, most = BITMAP_BITS
    bits = min(max(1 << (16 * distinct).bit_length(), least), most)
    place = F.col("fp").bitwiseAND(F.lit(bits - 1))
    parts = (
        marks.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        .collect()
    )
    flags = np.zeros(bits // 8, dtype=np.uint8)
    for part in parts:
        if part["bucket"] < 1:  # place 0, which always counts as marked
            continue
        at = (part["bucket"] - 1) * 4096  # bucket n holds the places (n - 1) * 32768 + 1 to n * 32768
        flags[at : at + 4096] = np.frombuffer(bytes(part["bits"]), dtype=np.uint8)
    return flags


def _marked(flags: np.ndarray, fps: np.ndarray) -> np.ndarray:
    place = (fps & np.uint64(8 * len(flags) - 1)).astype(np.int64)
    # place p >= 1 is bit (p - 1) of the bitmaps laid end to end; place 0 is always marked
    bit = np.maximum(place - 1, 0)
    return ((flags[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool) | (place == 0)


def marked_points(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_words, found) per row: its fingerprints that the benchmark's bitmap marks."""
    flags = documents.sparkSession.sparkContext.broadcast(_bitmap(known))
    short = sorted(r["need"] for r in known.where(f"need < {WINDOW}").select("need").distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, offsets in K.slices(batch.column("text")):
                words = K.words(raw, offsets, K.ALNUM)
                n_docs = len(words.counts)
                at, marks = points(words)
                hit = _marked(flags.value, marks)
                starts, fps, needs = [at[hit]], [marks[hit]], [np.full(int(hit.sum()), WINDOW)]
                for n in short:
                    at = np.flatnonzero(words.room(n))
                    whole = _runs(words, at, n)
                    hit = _marked(flags.value, whole)
                    starts.append(at[hit])
                    fps.append(whole[hit])
                    needs.append(np.full(int(hit.sum()), n))
                start = np.concatenate(starts)
                order = np.argsort(start, kind="stable")
                start, need = start[order], np.concatenate(needs)[order]
                owner = np.searchsorted(words.first, start, side="right") - 1
                structs = pa.StructArray.from_arrays(
                    [
                        pa.array((start - words.first[owner]).astype(np.int32)),
                        pa.array(need.astype(np.int32)),
                        pa.array(np.concatenate(fps)[order].view(np.int64)),
                        *_around(words, start, np.where(need == WINDOW, REACH, 0)),
                    ],
                    names=["start", "need", "fp", "before", "after"],
                )
                bounds = pa.array(np.searchsorted(owner, np.arange(n_docs + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, n_docs),
                        batch.column("row_key").slice(row, n_docs),
                        pa.array(words.counts.astype(np.int64)),
                        pa.ListArray.from_arrays(bounds, structs),
                    ],
                    names=["doc_id", "row_key", "n_words", "found"],
                )

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), wide_row_key().alias("row_key"))
    return docs.mapInArrow(run, f"doc_id long, row_key string, n_words long, found {_FOUND}")


def _alike(a: str, b: str) -> Column:
    """How many entries two lists have in common from their first on."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs == 0, F.greatest(F.size(a), F.size(b))).otherwise(differs - 1).cast("int")


def shared_spans(base: DataFrame, known: DataFrame) -> DataFrame:
    """(row_key, start, stop, place): hits of ``base`` extended to both sides, those long enough."""
    own = (
        base.where(F.size("found") > 0)
        .select("row_key", F.explode("found").alias("w"))
        .select("row_key", "w.start", "w.need", "w.fp", "w.before", "w.after")
        .distinct()
    )
    # surroundings are told once, however many items have them; both sides are distinct by more than the join's key, so
    # each has an exchange of its own below the join and a hot fingerprint can be split
    places = known.select(
        "need", "fp", F.col("before").alias("item_before"), F.col("after").alias("item_after"), "place"
    ).distinct()
    left, right = _alike("before", "item_before"), _alike("after", "item_after")
    size = F.when(F.col("need") == WINDOW, GRAM).otherwise(F.col("need"))
    met = own.join(places, ["fp", "need"])
    spans = met.select(
        "row_key", "place", "need", (F.col("start") - left).alias("start"), (F.col("start") + size + right).alias("stop")
    )
    return spans.where("stop - start >= need").drop("need")


def _hits(documents: DataFrame, benchmark: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: documents with their marked fingerprints, spans in common, fingerprints of the benchmark."""
    known = written(benchmark_points(benchmark), folder, "points")
    base = written(marked_points(documents, known), folder, "documents")
    return base, written(shared_spans(base, known), folder, "spans"), known


def decontaminated(documents: DataFrame, benchmark: DataFrame, folder: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``documents``, all columns, that have no window in common with a benchmark item.

    Up to ``broadcast_rows`` hit rows their keys go to every task and no text crosses the network; beyond that the
    same join shuffles and sorts both sides.
    """
    folder = folder or shared_dir(documents.sparkSession)
    _, spans, _ = _hits(documents, benchmark, folder)
    bad = written(spans.select("row_key").distinct(), folder, "hit-rows")
    way = "broadcast" if bad.count() <= broadcast_rows else "merge"
    keyed = documents.withColumn("__key", wide_row_key())
    return keyed.join(bad.hint(way), F.col("__key") == F.col("row_key"), "left_anti").select(*documents.columns)


def contamination(documents: DataFrame, benchmark: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items for each row of ``documents``."""
    folder = folder or shared_dir(documents.sparkSession)
    base, spans, known = _hits(documents, benchmark, folder)
    per_row = spans.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    # spans are sorted, so each adds what lies beyond the furthest word so far
    covered = F.expr(
        "aggregate(spans, named_struct('n', 0, 'reach', 0), (a, s) -> named_struct("
        "'n', a.n + greatest(s.stop - greatest(s.start, a.reach), 0), 'reach', greatest(a.reach, s.stop)), a -> a.n)"
    )
    owners = known.where("item_id is not null").select("place", "item_id").distinct()
    of_row = spans.select("row_key", "place").distinct().join(owners, "place").select("row_key", "item_id")
    named = of_row.distinct().groupBy("row_key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    hits = per_row.select("row_key", covered.cast("long").alias("hit")).join(named, "row_key", "left")
    touched = base.where(F.size("found") > 0).drop("found").join(hits.hint("rebalance"), "row_key", "left")
    # most rows have no marked fingerprint and cross no network
    nothing = {"hit": F.lit(None).cast("long"), "items": F.lit(None).cast("array<string>")}
    clean = base.where(F.size("found") == 0).drop("found").withColumns(nothing)
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("hit", F.lit(0).cast("long"))
    return touched.unionByName(clean).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        items.alias("items"),
    )
