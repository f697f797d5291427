"""Place scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE_COLUMNS = ["name", "country", "locality", "region", "fsq_category_labels"]


def scan_places(places: DataFrame, country: str = "CA") -> DataFrame:
    """The five place columns of one country; filter and columns reach the parquet scan."""
    kept = [c for c in PLACE_COLUMNS if c in places.columns]
    extra = [c for c in places.columns if c in ("labels", "position", "place_id")]
    return places.select(*kept, *extra).where(F.col("country") == country)


def read_places(spark: SparkSession, path: str, country: str = "CA") -> DataFrame:
    return scan_places(spark.read.parquet(path), country)


def latest_release(rows: DataFrame, release: str = "release") -> DataFrame:
    """Rows of the last release by name. With `release` as partition folder only
    that folder is read. Raises when there is no release."""
    last = rows.agg(F.max(F.col(release).cast("string"))).first()[0]
    if last is None:
        raise ValueError("no place release found")
    return rows.where(F.col(release).cast("string") == last)


def cap_rows(rows: DataFrame, n: int | None, order: list[Column]) -> DataFrame:
    """The first n rows of a total order; all rows without a cap."""
    return rows if n is None else rows.orderBy(*order).limit(n)
