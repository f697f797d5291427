"""Session helper, input spreading and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType


def build_session(app: str = "spendlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC timestamps.

    On a cluster leave `master` unset and let spark-submit decide; shuffle
    partitions stay with the cluster's setting there and AQE coalesces them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input has fewer splits than that.

    A small file is one split however costly its rows are. Large inputs have
    more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder `spark.checkpoint.dir` names; it must be shared storage on a cluster.

    Only a local session without the setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return tempfile.gettempdir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to a table in the shared folder and read back.

    Later steps start from files, so a lost executor costs no recomputation of
    what came before, and branches that use the rows do not repeat it. Files
    hold no columns of the void type; these are added again.
    """
    path = f"{shared_folder(df.sparkSession)}/spendlens-{uuid.uuid4().hex}"
    void = {field.name for field in df.schema.fields if isinstance(field.dataType, NullType)}
    kept = df.drop(*void) if void else df
    kept.write.parquet(path)
    rows = df.sparkSession.read.schema(kept.schema).parquet(path)
    return rows.select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns]) if void else rows
