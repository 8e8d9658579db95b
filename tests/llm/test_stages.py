"""Stages of the pipeline on rows without an id and rows that share one."""

import corpus_pipeline
from tests.conftest import rows

ITEM = "zero one two three four five six seven eight nine ten eleven"
SCHEMA = "doc_id long, text string, source string"


def text(n):
    return " ".join(f"{n}word{i}" for i in range(30))


def test_rows_go_by_themselves_and_not_by_id(spark, tmp_path):
    spark.createDataFrame([("b1", ITEM)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(None, text(1), "s"), (None, text(2), "s"), (7, text(3), "s"), (8, text(4), "s")]
    dirty = [(None, f"{text(5)} {ITEM}", "s"), (7, f"{text(6)} {ITEM}", "s")]
    left = corpus_pipeline.decontaminate(spark, spark.createDataFrame(clean + dirty, SCHEMA), str(tmp_path))
    assert rows(left) == rows(spark.createDataFrame(clean, SCHEMA))


def test_copies_are_rows_with_alike_texts(spark):
    table = [
        (1, text(1), "s"), (5, text(1) + " more", "s"), (5, text(2), "s"), (5, text(3), "s"), (5, text(3), "s"),
        (None, text(4), "s"), (None, text(4).upper(), "s"), (None, text(2), "s"), (None, text(6), "s"), (9, None, "s"), (9, "", "s"),
    ]
    left = rows(corpus_pipeline.near_duplicates(spark, spark.createDataFrame(table, SCHEMA), ""), "doc_id", "text")
    assert [r for r in left if r[0] is not None] == sorted(
        [(1, text(1)), (5, text(2)), (5, text(3)), (9, ""), (9, None)], key=lambda r: (r[0], r[1] is None, r[1] or "")
    )
    without = [r[1].lower() for r in left if r[0] is None]
    assert sorted(without) == sorted([text(4), text(6)])
