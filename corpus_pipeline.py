"""The training-data pipeline: documents pass five stages, each working on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as parquet to the shared folder and
rereads it as the next stage's docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.llm import best_fit, line_quality, minmax_dedup, secret_forest, winnowing
from tidelag.llm.common import numbered, shared_dir, wide_row_key, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    field = line_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_quality.filter_documents(docs, field)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id (NULL last); equal rows count as copies.

    Rows are judged by id and text, so those that share an id, or have none, stay where their texts differ.
    """
    folder = shared_dir(spark)
    keyed = numbered(docs, folder)
    found = minmax_dedup.dedup(keyed.select(F.col("__row").alias("doc_id"), "text"), folder)
    known = keyed.select("__row", F.col("doc_id").cast("long").alias("id"), wide_row_key().alias("own"))
    # texts without a word are linked with nothing, only equal rows are copies
    group = F.when(F.col("n_shingles") > 0, F.col("component_id").cast("string")).otherwise(F.col("own"))
    order = F.struct(F.col("id").isNull(), "id", "__row")
    grouped = found.join(known, F.col("__row") == found.doc_id).groupBy(group.alias("group"))
    kept = grouped.agg(F.min(order).alias("first")).select("first.__row")
    return keyed.join(kept, "__row", "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item; each row is judged by its own text."""
    return winnowing.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    out = secret_forest.redacted(docs, secret_forest.train_by_rule(docs))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which bin, slot and span every document fills."""
    return best_fit.pack(best_fit.measured(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]

# Fitted models decide in stages 1 and 4, so SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return docs
