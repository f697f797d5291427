"""Run registered queries against their SQL and print what differs.

usage: python -m checks.compare [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.catalog import ORACLES, QUERIES
from spendlens.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if value != value:
            return None
        return int(value) if value.is_integer() else round(value, 6)
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return value


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in row) for row in df.itertuples(index=False, name=None)), key=repr)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    left, right = rows_of(spark_df), rows_of(sql_df)
    if len(left) != len(right):
        only = [r for r in left if r not in set(right)][:2], [r for r in right if r not in set(left)][:2]
        return f"rows {len(left)} != {len(right)} e.g. {only}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} of {len(left)} rows differ, e.g. {bad[0]}" if bad else None


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(
        "compare",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = []
    for name, run in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.perf_counter()
        try:
            found = run(spark, sf).toPandas()
            spent = time.perf_counter() - start
            note = f"{len(found)} rows"
            if name in ORACLES:
                start = time.perf_counter()
                wanted = con.execute(ORACLES[name]).df()
                note += f", sql {time.perf_counter() - start:.1f}s"
                problem = difference(found, wanted)
            else:
                note += ", rows only"
                problem = None if len(found) else "no rows"
        except Exception as error:
            spent = time.perf_counter() - start
            problem, note = f"{type(error).__name__}: {str(error)[:700]}", ""
        spark.catalog.clearCache()
        print(f"{'FAIL' if problem else 'ok  '} {name} {spent:.1f}s {note} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
