"""Ranking helpers that keep hot groups spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """Best n rows per key, ranked from 1 by a total order.

    The rank filter lets Spark cut each group inside every input partition
    (WindowGroupLimit), so a hot key sends at most n rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the smallest `order` per key, by a combining aggregate."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*")


def hashed_rank(
    df: DataFrame,
    keys: list[str],
    digest: str,
    rank: str = "rank",
    total: str | None = None,
    digits: int = 3,
) -> DataFrame:
    """Exact row number per key in the order of a hex digest column.

    Rows are ranked inside (key, digest prefix) and shifted by the sizes of the
    prefixes before it, so one huge key is shared by 16**digits groups. The
    digest must be unique within a key. `total` adds the size of the key.
    """
    prefixed = df.withColumn("_prefix", F.substring(digest, 1, digits))
    groups = [*keys, "_prefix"]
    sizes = prefixed.groupBy(*groups).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(g).alias(f"_o_{g}") for g in groups],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    local = prefixed.withColumn("_local", F.row_number().over(Window.partitionBy(*groups).orderBy(digest)))
    same = [F.col(g).eqNullSafe(F.col(f"_o_{g}")) for g in groups]
    out = local.join(offsets, same, "inner").withColumn(rank, F.col("_local") + F.col("_offset"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_prefix", "_local", "_offset", "_total", *[f"_o_{g}" for g in groups])


def most_frequent(df: DataFrame, keys: list[str], value: str, n: int, first_seen: str) -> DataFrame:
    """Top n values per key by count, ties to the value seen first."""
    counts = df.groupBy(*keys, value).agg(
        F.count("*").alias("n"), F.min(first_seen).alias("_first")
    )
    return top_n(counts, keys, [F.desc("n"), F.asc("_first"), F.asc(value)], n).drop("_first")
