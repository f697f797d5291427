"""Result sinks and the run registry."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_TYPE = "version string, model_type string, metrics string, parameters string, train_rows long, notes string"


def write_rows(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Rows with predictions as parquet or CSV with a header; CSV holds nested columns as JSON."""
    if form == "csv":
        nested = (T.ArrayType, T.MapType, T.StructType)
        columns = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else f.name for f in df.schema]
        df.select(*columns).write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        df.write.mode("overwrite").parquet(path)


def register_run(
    spark: SparkSession,
    path: str,
    model_type: str,
    version: str,
    metrics: dict,
    parameters: dict,
    train_rows: int,
    notes: str = "",
) -> None:
    """Append one run to the registry table."""
    row = (version, model_type, json.dumps(metrics), json.dumps(parameters), train_rows, notes)
    run = spark.createDataFrame([row], RUN_TYPE).withColumn("registered_at", F.current_timestamp())
    run.write.mode("append").parquet(path)


def stamped(df: DataFrame, version: str | Column) -> DataFrame:
    """Outputs marked with the model version that made them."""
    return df.withColumn("model_version", F.lit(version) if isinstance(version, str) else version)
