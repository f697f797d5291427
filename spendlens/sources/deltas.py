"""Tables that grow by deltas: a merge writes the rows it adds, in folders by a hash of their key, and rewrites nothing.

A manifest row lists a version and the first delta that it reads, so a job lost half way is never seen. Readers put
the deltas together; `compact` starts a new base when there are many.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, base long, buckets int, written_at timestamp"
BUCKETS = 64


class Deltas(NamedTuple):
    version: int
    base: int
    buckets: int


def newest(spark: SparkSession, root: str) -> Deltas | None:
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
        last = rows.agg(F.max(F.struct("version", "base", "buckets")).alias("m")).first().m
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return None if last is None else Deltas(*last)


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_deltas(spark: SparkSession, root: str, name: str, schema: str, at: Deltas) -> DataFrame:
    """Rows of all deltas of a version, with `delta` and `bucket`; both are folders."""
    folders = [f"{root}/{name}/delta={n}" for n in range(at.base, at.version + 1)]
    reader = spark.read.option("basePath", f"{root}/{name}").schema(f"{schema}, delta long, bucket int")
    return reader.parquet(*folders)


def touched(rows: DataFrame, key: str, batch: DataFrame, buckets: int) -> DataFrame:
    """The rows of the buckets that a batch's keys fall into: at most `buckets` numbers go to the driver."""
    found = batch.select(bucket_of(key, buckets).alias("b")).distinct().collect()
    return rows.where(F.col("bucket").isin([r.b for r in found]))


def publish_delta(
    spark: SparkSession, root: str, tables: dict[str, tuple[DataFrame, str]], reset: bool = False
) -> int:
    """Write every table's rows, dealt by its key, as the next delta, then list it. With `reset` older deltas
    are read no more."""
    at = newest(spark, root)
    version = at.version + 1 if at else 1
    base, buckets = (version, at.buckets if at else BUCKETS) if reset or at is None else (at.base, at.buckets)
    for name, (rows, key) in tables.items():
        dealt = rows.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").sortWithinPartitions("bucket", key)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{name}/delta={version}")
    row = spark.range(1).select(
        F.lit(version).cast("long").alias("version"),
        F.lit(base).cast("long").alias("base"),
        F.lit(buckets).cast("int").alias("buckets"),
        F.current_timestamp().alias("written_at"),
    )
    row.write.mode("append").parquet(f"{root}/manifest")
    return version
