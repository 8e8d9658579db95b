"""Folder names on whatever storage Spark writes to, through its Hadoop file system (not on Spark Connect)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it does not exist."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def complete(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables in a folder whose writing has ended."""
    return [n for n in names(spark, path) if "_SUCCESS" in names(spark, f"{path}/{n}")]


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)
