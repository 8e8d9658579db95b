"""Rows that repeat without end, passages in many documents, fingerprints as they are selected."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import rows
from tidelag.llm import best_fit, textkernel, winnowing


def kernel_words(text):
    ((_, raw, offsets),) = textkernel.slices(pa.array([text]))
    return textkernel.words(raw, offsets, textkernel.ALNUM)


def test_points_are_the_last_least_run_of_each_window():
    pick = random.Random(2)
    for n in (0, 1, 9, 10, 11, 60):
        words = kernel_words(" ".join(pick.choice("abc") for _ in range(n)))
        grams = words.grams(winnowing.GRAM)
        want = set()
        for start in range(n - winnowing.WINDOW + 1):
            places = range(start, start + winnowing.REACH + 1)
            want.add(min(places, key=lambda p: (grams[p], -p)))
        at, hashes = winnowing.points(words)
        assert at.tolist() == sorted(want) and hashes.tolist() == grams[at].tolist()


def test_every_shared_window_has_a_point_in_common():
    pick = random.Random(4)
    for _ in range(50):
        shared = [f"s{pick.random()}" for _ in range(winnowing.WINDOW)]
        sides = []
        for _ in range(2):
            around = [[f"w{pick.random()}" for _ in range(pick.randrange(15))] for _ in range(2)]
            sides.append(set(winnowing.points(kernel_words(" ".join([*around[0], *shared, *around[1]]).replace(".", "")))[1].tolist()))
        assert sides[0] & sides[1]


def test_runs_alike_with_other_words_around_are_no_hit(spark):
    run = " ".join(f"r{i}" for i in range(winnowing.GRAM))
    benchmark = spark.createDataFrame([(1, f"a b {run} c d"), (2, f"e f {run} g h")], "item_id long, text string")
    texts = {1: f"x b {run} g y", 2: f"x b {run} y", 3: f"x {run} y", 4: f"z f {run} g z", 5: f"a b {run}"}
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in winnowing.contamination(documents, benchmark).collect()}
    # 1: nine words of either item, but no ten of one
    assert got == {1: (0, []), 2: (0, []), 3: (0, []), 4: (10, ["2"]), 5: (10, ["1"])}


def test_a_passage_of_all_documents_and_items(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    benchmark = spark.range(40).select(F.col("id").alias("item_id"), F.lit(passage).alias("text"))
    documents = spark.range(3000).select(F.lit(7).alias("doc_id"), F.concat(F.lit(passage + " own"), F.col("id") % 1000).alias("text"))
    found = winnowing.contamination(documents, benchmark).groupBy("n_hit", "n_items", "n_words").count().collect()
    assert [tuple(r) for r in found] == [(12, 40, 13, 3000)]
    clean = documents.limit(1).select("doc_id", F.lit("nothing in common").alias("text"))
    assert rows(winnowing.decontaminated(documents.unionByName(clean), benchmark)) == [(7, "nothing in common")]
    # beyond the bound of the broadcast, the same rows by a shuffled join
    shuffled = winnowing.decontaminated(documents.unionByName(clean), benchmark, broadcast_rows=0)
    assert rows(shuffled) == [(7, "nothing in common")]


def test_equal_rows_are_dealt_to_many_shards(spark):
    one = spark.range(9000).select(
        F.lit(3).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit(5).cast("long").alias("cluster"), F.lit(10).alias("length")
    )
    packed = best_fit.pack(one, shard_documents=500).collect()
    shards = Counter(r.bin_id >> 32 for r in packed)
    assert len(packed) == 9000 and len(shards) == 18 and max(shards.values()) < 700
    assert len({r.bin_id for r in packed}) == 9000  # one of a cluster to a bin
    numbers = np.array(sorted(r["copy"] for r in best_fit._copies(one).collect()))
    assert (numbers == np.arange(9000)).all()
    odd = spark.createDataFrame([(None, None, None, 1), (None, None, None, 1)], "doc_id long, source string, cluster long, length int")
    assert best_fit.pack(odd).count() == 2


def test_repeated_rows_of_the_pipeline(spark):
    table = [(1, "", "s"), (1, "", "s"), (2, None, "s"), (2, None, "s"), (None, "", "s"), (3, "a b c d e", "s"), (3, "a b c d e", "s")]
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(table, "doc_id long, text string, source string"), "")
    assert rows(left) == [(1, "", "s"), (2, None, "s"), (3, "a b c d e", "s"), (None, "", "s")]
