"""Versioned parquet tables: a new folder per write, published by a manifest row.

Readers only see versions the manifest lists, so a job lost half way leaves the
last good version in place.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, written_at timestamp"


def manifest(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def current_version(spark: SparkSession, root: str) -> int | None:
    rows = manifest(spark, root)
    return None if rows is None else rows.agg(F.max("version")).first()[0]


def read_version(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame | None:
    version = current_version(spark, root) if version is None else version
    return None if version is None else spark.read.parquet(f"{root}/v{version:06d}/{name}")


def publish(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], partitions: dict[str, list[str]] | None = None
) -> int:
    """Write all tables as the next version, then list it. Returns the version."""
    version = (current_version(spark, root) or 0) + 1
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        keys = (partitions or {}).get(name)
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{root}/v{version:06d}/{name}")
    row = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.current_timestamp().alias("written_at"))
    row.write.mode("append").parquet(f"{root}/manifest")
    return version
