"""Headline queries timed at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid

from pyspark.sql import functions as F

from checks.catalog import QUERIES
from checks.search_queries import docs, table
from spendlens.functions.terms import query_words
from spendlens.operators.lexical import bm25_query_terms
from spendlens.operators.stored_index import build_index, search_terms
from spendlens.session import build_session, shared_folder

HEADLINE = [
    "r6_batch_rows",
    "n_clean_counts",
    "e3_breakdown",
    "b5_first_entries",
    "b9_group_category",
    "j5_bm25_top5",
    "j7_dense_top6",
    "j9_fusion",
    "l2_line_islands",
    "t1_stratified_split",
]


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def index_times(spark, sf: str) -> dict[str, float]:
    """A stored index of all documents: built once, then searched twice."""
    seconds, start = {}, time.perf_counter()
    index = build_index(docs(spark, sf), "doc_id", "text", f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}", bins=16)
    seconds["index_build"] = time.perf_counter() - start
    for name in ("index_search", "index_search_again"):
        start = time.perf_counter()
        wanted = bm25_query_terms(table(spark, sf, "benchmark"), "item_id", query_words(F.upper("text")))
        noop(search_terms(index, wanted, 5, "item_id"))
        seconds[name] = time.perf_counter() - start
    return {name: round(value, 3) for name, value in seconds.items()}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        noop(QUERIES[name](spark, sf))
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    stored = index_times(spark, sf)
    start = time.perf_counter()
    noop(spark.range(300_000_000).selectExpr("sum(xxhash64(id) % 1000) AS s"))
    control = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf,
                "stored_index": stored,
                "control": control,  # the machine alone: hashes of 300 million numbers
                "classified_rows_per_second": round(rows / seconds["r6_batch_rows"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
