"""Reading of the canonical tables from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, directory: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A parquet table ``<directory>/<name>.parquet``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, directory: str, schema: T.StructType, **options: str) -> DataFrame:
    """A stream of the parquet files arriving in ``directory``."""
    return spark.readStream.schema(schema).options(**options).parquet(directory)
