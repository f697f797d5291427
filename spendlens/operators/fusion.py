"""Candidate lists fused, cut, scored and turned into one match per query."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.rows import posexploded
from spendlens.functions.terms import index_words
from spendlens.operators.ranking import top_n
from spendlens.options import DEFAULTS, Options

LIST_TYPE = "query_id string, entry_id string, score double, rank int"


class PairScorer(Protocol):
    """Picklable; returns one raw score per (query, document), before the sigmoid."""

    def score(self, queries: list[str], documents: list[str]) -> list[float]: ...


def seed_list(exact: DataFrame, ids: str = "seed_ids") -> DataFrame:
    """(query_id, entry_id, score, rank) of exact-alias candidates in list order."""
    return posexploded(exact, ["query_id"], ids, "pos", "entry_id").select(
        "query_id", "entry_id", F.lit(1.0).alias("score"), (F.col("pos") + 1).alias("rank")
    )


def fuse(
    lexical: DataFrame | None,
    dense: DataFrame | None,
    seeds: DataFrame | None,
    options: Options = DEFAULTS,
) -> DataFrame:
    """Reciprocal-rank fusion of up to three ranked lists (ranks from 1).

    An entry seen by a search takes that search's score even when it was also a
    seed. `place` orders equal fused scores: seeds, lexical, dense, then rank.
    """
    parts = []
    for order, (name, ranked, share) in enumerate(
        [
            ("seed", seeds, options.seed_weight / F.col("rank")),
            ("lexical", lexical, options.lexical_weight / (options.fusion_k + F.col("rank"))),
            ("dense", dense, options.dense_weight / (options.fusion_k + F.col("rank"))),
        ]
    ):
        if ranked is not None:
            parts.append(
                ranked.select(
                    "query_id",
                    "entry_id",
                    F.lit(name).alias("list"),
                    F.col("score").cast("double").alias("score"),
                    share.alias("share"),
                    F.struct(F.lit(order).alias("list_order"), F.col("rank").cast("int").alias("rank")).alias("place"),
                )
            )
    if not parts:
        raise ValueError("no candidate list given")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("list") == name, F.col(column)))

    seeded = F.max(F.when(F.col("list") == "seed", F.lit(1.0)))
    zero = F.lit(0.0)
    return rows.groupBy("query_id", "entry_id").agg(
        F.coalesce(of("lexical", "score"), seeded).alias("lexical_score"),
        F.coalesce(of("dense", "score"), seeded).alias("dense_score"),
        seeded.isNotNull().alias("is_seed"),
        (
            F.coalesce(of("seed", "share"), zero)
            + F.coalesce(of("lexical", "share"), zero)
            + F.coalesce(of("dense", "share"), zero)
        ).alias("fused_score"),
        F.min("place").alias("place"),
    )


def cut(fused: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    return top_n(
        fused, ["query_id"], [F.desc("fused_score"), F.asc("place"), F.asc("entry_id")], options.rerank_candidates
    )


def overlap_score(query: Column, document: Column) -> Column:
    """Share of the query's distinct words that the document holds."""
    wanted = F.array_distinct(index_words(query))
    found = F.size(F.array_intersect(wanted, index_words(document)))
    return F.when(F.size(wanted) > 0, found / F.size(wanted)).otherwise(F.lit(0.0))


def pair_scores(query: Column, document: Column, scorer: PairScorer) -> Column:
    """Sigmoid of an external scorer's raw score, in Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, documents in batches:
            raw = np.asarray(scorer.score(queries.tolist(), documents.tolist()), dtype=np.float64)
            yield pd.Series(1.0 / (1.0 + np.exp(-raw)))

    return run(query, document)


def rerank(candidates: DataFrame, query: str, document: str, scorer: PairScorer | str | None) -> DataFrame:
    """Candidates with `rerank_score`; null without a scorer ("overlap" is built in)."""
    if scorer is None:
        return candidates.withColumn("rerank_score", F.lit(None).cast("double"))
    if scorer == "overlap":
        score = overlap_score(F.col(query), F.col(document))
    else:
        score = pair_scores(F.col(query), F.col(document), scorer)
    return candidates.withColumn("rerank_score", score)


def choose(candidates: DataFrame, query: str, options: Options = DEFAULTS) -> DataFrame:
    """One match per query, or none: the best reranked candidate when its score
    is high enough, else the top fused candidate by its own search scores.

    Input: cut candidates with rerank_score, canonical_name and the query text.
    """
    own = F.greatest(F.coalesce("dense_score", F.lit(0.0)), F.coalesce("lexical_score", F.lit(0.0)))
    kept = F.struct(
        "entry_id", "canonical_name", "is_seed", "dense_score", "lexical_score", "fused_score", "rerank_score",
        own.alias("own_score"),
    )
    best = candidates.groupBy("query_id", query).agg(
        F.max_by(kept, F.when(F.col("rerank_score").isNotNull(), F.struct("rerank_score", -F.col("rank")))).alias("r"),
        F.min_by(kept, "rank").alias("f"),
    )
    reranked = F.col("r.rerank_score") >= options.min_similarity
    fallback = F.col("f.own_score") >= options.min_similarity
    picked = best.select(
        "query_id",
        query,
        F.when(reranked, F.col("r")).when(fallback, F.col("f")).alias("m"),
        F.when(reranked, F.lit("rerank")).otherwise(F.lit("dense_lexical")).alias("strategy"),
    ).where(F.col("m").isNotNull())
    return picked.select(
        "query_id",
        "m.entry_id",
        F.when(F.col("m.is_seed"), F.col(query)).otherwise(F.col("m.canonical_name")).alias("matched_alias"),
        F.when(F.col("strategy") == "rerank", F.col("m.rerank_score")).otherwise(F.col("m.own_score")).alias("similarity"),
        "strategy",
        "m.dense_score",
        "m.lexical_score",
        "m.fused_score",
        F.when(F.col("strategy") == "rerank", F.col("m.rerank_score")).alias("rerank_score"),
    )
