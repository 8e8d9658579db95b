"""Helpers shared by the training-data operators: shared folders, written tables, id rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share.

    It lies in ``spark.checkpoint.dir``.  Where that is unset, a local master gets a temporary folder
    and a cluster gets a folder in the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.split("[")[0] == "local"
        root = tempfile.mkdtemp(prefix="llm-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder: computed once, lineage cut, safe from lost executors."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_crc(column: str) -> Column:
    """Unsigned crc32 of an id written as text; NULL ids give NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def numbered(documents: DataFrame, folder: str, name: str = "numbered") -> DataFrame:
    """``documents`` with ``__row``, a number of each row's own, whatever its id; written, so that it stays the same."""
    return written(documents.withColumn("__row", F.monotonically_increasing_id()), folder, name)


def wide_row_key() -> Column:
    """A 128-bit key of the row's id and text, as text: equal for equal rows alone, also where ids are NULL or repeat."""
    told = [F.coalesce(F.concat(F.lit("1"), F.col(c).cast("string")), F.lit("0")) for c in ("doc_id", "text")]
    return F.md5(F.concat(told[0], F.lit(":"), told[1]).cast("binary"))


def hash_sample(labels: DataFrame, by: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, those with the smallest hash of ``by``; used only to fit models."""
    return labels.orderBy(F.xxhash64(F.col(by)), F.col(by)).limit(bound)


def texts_of(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """Texts of a bounded sample (doc_id, label).  The sample is bounded by its caller, so it may be broadcast."""
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
