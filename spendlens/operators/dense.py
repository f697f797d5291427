"""Exact nearest neighbours by cosine similarity over large vector tables.

Vectors are assigned to the nearest of a fixed number of pivots. A query gets a
first k-th best distance from part of its own cell, and then visits only the
cells that the triangle inequality does not rule out. Cells and their visitors
are cut into blocks, so a crowded cell is shared by many tasks. Identical
vectors are searched once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.operators.ranking import top_n

PIVOTS = 64
BLOCK = 2048
DIGITS = 6
SLACK = 1e-5


def vector_key(vector: Column) -> Column:
    return F.md5(F.concat_ws(",", vector.cast("array<string>")))


def plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strings as Python objects: one Arrow chunk per column on the way out."""
    texts = [c for c in pdf.columns if pd.api.types.is_string_dtype(pdf[c].dtype)]
    return pdf.astype({c: object for c in texts})


def unit_rows(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit vectors (zero vectors count as norm 0)."""
    squares = (left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2 * left @ right.T
    return np.sqrt(np.maximum(squares, 0.0))


def pick_pivots(corpus: DataFrame, n: int) -> np.ndarray:
    """n distinct vectors in key order, a fixed-size sample held by the driver."""
    rows = corpus.select("vkey", "vector").distinct().orderBy("vkey").limit(n).collect()
    return unit_rows([r["vector"] for r in rows])


def with_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot and the distance to it."""
    schema = T.StructType(
        [*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())]
    )

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                apart = distances(unit_rows(pdf["vector"]), pivots)
                cell = apart.argmin(1)
                yield plain(pdf.assign(cell=cell.astype(np.int32), radius=apart[np.arange(len(pdf)), cell]))

    return df.mapInPandas(assign, schema)


def best_columns(scores: np.ndarray, keep: int) -> np.ndarray:
    """The `keep` best columns of each row, best first, ties to the smaller column; no row is sorted whole."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    least = np.partition(scores, -keep, axis=1)[:, -keep, None]
    picked = scores >= least
    tied = picked.sum(axis=1) > keep
    if tied.any():
        level = scores[tied] == least[tied]
        room = keep - (picked[tied] & ~level).sum(axis=1, keepdims=True)
        picked[tied] &= ~level | (level.cumsum(axis=1) <= room)
    columns = np.nonzero(picked)[1].reshape(len(scores), keep)
    order = np.argsort(-np.take_along_axis(scores, columns, 1), axis=1, kind="stable")
    return np.take_along_axis(columns, order, 1)


def best_in_block(k: int, queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
    """k best corpus rows per query row of one block pair.

    A query with a `floor` above zero, which its k-th best similarity reaches, keeps no row below it.
    """
    if not len(queries) or not len(corpus):
        return pd.DataFrame({"qkey": [], "entry_id": [], "similarity": []}, dtype=object)
    corpus = corpus.sort_values("entry_id", kind="stable")
    raw = unit_rows(queries["vector"]) @ unit_rows(corpus["vector"]).T
    floor = queries["floor"].to_numpy() if "floor" in queries else np.zeros(len(queries))
    bare, held = np.nonzero(~(floor > 0))[0], np.nonzero(floor > 0)[0]
    # Columns are in id order, so of equal scores the smaller column comes first.
    best = best_columns(rounded(raw[bare]), min(k, raw.shape[1])) if len(bare) else np.empty((0, 1), dtype=int)
    # Rounding lifts a similarity by less than SLACK.
    row, column = np.nonzero(raw[held] >= (floor[held] - SLACK)[:, None])
    row = held[row]
    scores = rounded(raw[row, column])
    order = np.lexsort((column, -scores, row))
    place = np.arange(len(order)) - np.searchsorted(row, row[order])  # rows come in order
    order = order[place < k]
    rows = np.concatenate([np.repeat(bare, best.shape[1]), row[order]])
    columns = np.concatenate([best.ravel(), column[order]])
    return pd.DataFrame(
        {
            "qkey": queries["vkey"].to_numpy()[rows],
            "entry_id": corpus["entry_id"].to_numpy()[columns],
            "similarity": rounded(raw[rows, columns]),
        }
    )


def rounded(similarity: np.ndarray) -> np.ndarray:
    return np.round(np.clip(similarity, 0.0, 1.0), DIGITS)


def join_blocks(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Block pairs that share (cell, qpart, part), scored and cut to k per query."""
    kind = corpus.schema["entry_id"].dataType.simpleString()

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return plain(best_in_block(k, left, right))

    keys = ["cell", "qpart", "part"]
    return (
        queries.groupBy(*keys)
        .cogroup(corpus.groupBy(*keys))
        .applyInPandas(score, f"qkey string, entry_id {kind}, similarity double")
    )


def part_of(key: str, parts: dict[int, int], cell: str = "cell") -> Column:
    """Hash part of a row inside its cell, given the number of parts per cell."""
    return F.pmod(F.xxhash64(key), F.lit(1) + extra_parts(parts, cell)).cast("int")


def extra_parts(parts: dict[int, int], cell: str = "cell") -> Column:
    many = {c: n for c, n in parts.items() if n > 1}
    if not many:
        return F.lit(0)
    table = F.create_map(*[F.lit(x) for c, n in many.items() for x in (c, n - 1)])
    return F.coalesce(F.try_element_at(table, F.col(cell)), F.lit(0))


def all_parts(parts: dict[int, int], cell: str = "cell") -> Column:
    return F.explode(F.sequence(F.lit(0), extra_parts(parts, cell)))


def visits(
    pivots: np.ndarray, lows: np.ndarray, highs: np.ndarray
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Cells each query must look into, from pivot distances and cell radii."""
    between = distances(pivots, pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            apart = distances(unit_rows(pdf["vector"]), pivots)
            own = apart.argmin(1)
            # A floor of zero ties with every clamped negative, so it rules nothing out.
            floor = np.where(pdf["floor"].to_numpy() <= 0, -1.0, pdf["floor"].to_numpy())
            reach = np.sqrt(np.maximum(2 - 2 * (floor - SLACK), 0.0))[:, None]
            bound = np.maximum(apart - highs[None, :], lows[None, :] - apart)
            gap = between[own]
            plane = np.divide(
                apart**2 - apart[np.arange(len(pdf)), own][:, None] ** 2,
                2 * gap,
                out=np.zeros_like(apart),
                where=gap > 0,
            )
            row, cell = np.nonzero(np.maximum(bound, plane) <= reach + SLACK)
            yield plain(
                pd.DataFrame(
                    {
                        "vkey": pdf["vkey"].to_numpy()[row],
                        "vector": pdf["vector"].to_numpy()[row],
                        "floor": pdf["floor"].to_numpy()[row],
                        "cell": cell.astype(np.int32),
                    }
                )
            )

    return run


def parts_by_cell(counts: list, block: int) -> dict[int, int]:
    return {r["cell"]: math.ceil(r["n"] / block) for r in counts}


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    pivots: int = PIVOTS,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, entry_id, similarity, rank): k most similar corpus rows per query.

    queries: query_id, vector. corpus: entry_id, vector. Similarity is cosine
    clamped to [0, 1] and rounded; ties go to the smaller entry id.
    """
    keyed_queries = queries.select("query_id", "vector", vector_key(F.col("vector")).alias("vkey"))
    distinct_queries = keyed_queries.groupBy("vkey").agg(F.any_value("vector").alias("vector"))
    keyed_corpus = corpus.select("entry_id", "vector", vector_key(F.col("vector")).alias("vkey"))
    # Of identical vectors only the k smallest ids can ever be returned.
    kept = top_n(keyed_corpus, ["vkey"], [F.asc("entry_id")], k).drop("rank")

    anchors = pick_pivots(keyed_corpus, pivots)
    if not len(anchors):
        empty = f"query_id {queries.schema['query_id'].dataType.simpleString()}, entry_id " \
            f"{corpus.schema['entry_id'].dataType.simpleString()}, similarity double, rank int"
        return queries.sparkSession.createDataFrame([], empty)
    cells = with_cells(kept, anchors).persist()
    shape = cells.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")
    ).collect()
    lows, highs = np.full(len(anchors), np.inf), np.full(len(anchors), -np.inf)
    for row in shape:
        lows[row["cell"]], highs[row["cell"]] = row["low"], row["high"]
    corpus_parts = parts_by_cell(shape, block)
    parted = cells.select("cell", "entry_id", "vector", part_of("vkey", corpus_parts).alias("part"))

    located = with_cells(distinct_queries, anchors).persist()
    query_parts = parts_by_cell(located.groupBy("cell").agg(F.count("*").alias("n")).collect(), block)
    first_look = join_blocks(
        located.select("cell", "vkey", "vector", part_of("vkey", query_parts).alias("qpart"), F.lit(0).alias("part")),
        parted.where("part = 0").select("*", all_parts(query_parts).alias("qpart")),
        k,
    )
    floors = (
        top_n(first_look, ["qkey"], [F.desc("similarity"), F.asc("entry_id")], k)
        .where(F.col("rank") == k)
        .select(F.col("qkey").alias("vkey"), F.col("similarity").alias("floor"))
    )
    bounded = located.select("vkey", "vector").join(floors, "vkey", "left").select(
        "vkey", "vector", F.coalesce("floor", F.lit(-1.0)).alias("floor")
    )
    vector_type = located.schema["vector"].dataType.simpleString()
    visiting = bounded.mapInPandas(
        visits(anchors, lows, highs), f"vkey string, vector {vector_type}, floor double, cell int"
    ).persist()
    visit_parts = parts_by_cell(visiting.groupBy("cell").agg(F.count("*").alias("n")).collect(), block)
    scored = join_blocks(
        visiting.select(
            "cell", "vkey", "vector", "floor",
            part_of("vkey", visit_parts).alias("qpart"), all_parts(corpus_parts).alias("part"),
        ),
        parted.select("*", all_parts(visit_parts).alias("qpart")),
        k,
    )
    best = top_n(scored, ["qkey"], [F.desc("similarity"), F.asc("entry_id")], k)
    return keyed_queries.select("query_id", F.col("vkey").alias("qkey")).join(best, "qkey").select(
        "query_id", "entry_id", "similarity", "rank"
    )
