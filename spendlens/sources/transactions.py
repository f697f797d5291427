"""Transaction, candidate-name and training-split scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.cleaning import with_clean

TRANSACTION_SCHEMA = (
    "date string, description string, amount double, type string, source_file string, account_type string"
)
NAME_COLUMNS = ["cleaned", "description", "raw_example"]


def read_transactions(spark: SparkSession, path: str, schema: str = TRANSACTION_SCHEMA) -> DataFrame:
    """Statement CSV with a header and a fixed schema (no inference pass)."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def candidate_names(rows: DataFrame, column: str | None = None) -> DataFrame:
    """Distinct cleaned names (`name`) of 3+ characters from the first known text column."""
    column = column or next((c for c in NAME_COLUMNS if c in rows.columns), None)
    if column is None or column not in rows.columns:
        raise ValueError("no usable text column")
    return with_clean(rows.select(column), column, "name").select("name").where(F.length("name") >= 3).distinct()


def training_rows(rows: DataFrame) -> DataFrame:
    """Rows with a non-empty cleaned text."""
    return rows.where(F.length("cleaned") > 0)
