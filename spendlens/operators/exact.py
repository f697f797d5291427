"""Exact alias lookup and multi-word brand windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.rows import exploded
from spendlens.functions.tokens import phrase_hits, phrase_positions, tokenize
from spendlens.operators.ranking import top_n
from spendlens.options import DEFAULTS, Options


def alias_index(aliases: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """One row per alias with its first few entry ids by (priority desc, entry_id).

    Only the kept ids are collected, so an alias shared by very many entries
    stays a short array.
    """
    kept = top_n(
        aliases.select("alias", "entry_id", "priority"),
        ["alias"],
        [F.desc("priority"), F.asc("entry_id")],
        options.lookup_limit,
    )
    return kept.groupBy("alias").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "entry_id"))), lambda s: s["entry_id"]
        ).alias("entry_ids")
    )


def lookup(queries: DataFrame, index: DataFrame, key: str, out: str) -> DataFrame:
    """Left join of distinct query keys to the alias index; empty array for a miss."""
    side = index.select(F.col("alias").alias("_alias"), F.col("entry_ids").alias(out))
    joined = queries.join(side, F.col(key) == F.col("_alias"), "left").drop("_alias")
    return joined.withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def brand_windows(texts: DataFrame, text: str) -> DataFrame:
    """Word windows of 3 and 2 free of descriptor phrases: (text, size, start, words)."""
    tokens = tokenize(F.col(text))
    prepared = texts.select(text, tokens.alias("tokens")).distinct().select(
        text, "tokens", phrase_positions(phrase_hits(F.col("tokens"))).alias("taken")
    )

    def windows(size: int):
        last = F.size("tokens") - size + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        free = F.filter(
            starts,
            lambda s: ~F.arrays_overlap(F.sequence(s, s + size - 1), F.col("taken")),
        )
        return F.transform(
            free,
            lambda s: F.struct(
                F.lit(size).alias("size"),
                s.alias("start"),
                F.concat_ws(" ", F.slice("tokens", s, size)).alias("words"),
            ),
        )

    return exploded(prepared, [text], F.concat(windows(3), windows(2)), "w").select(text, "w.*")


def brand_positions(texts: DataFrame, aliases: DataFrame, text: str) -> DataFrame:
    """Per text, the positions of words in multi-word brands (text, brand_positions).

    Windows that are an alias are taken greedily: three words before two, left
    to right, never overlapping.
    """
    known = aliases.select(F.col("alias").alias("_alias")).distinct()
    hits = brand_windows(texts, text).join(known, F.col("words") == F.col("_alias"), "left_semi")
    ordered = hits.groupBy(text).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("neg"), "start"))).alias("hits")
    )
    picked = F.aggregate(
        "hits",
        F.array().cast("array<int>"),
        lambda acc, h: F.when(
            F.arrays_overlap(acc, F.sequence(h["start"], h["start"] - h["neg"] - 1)), acc
        ).otherwise(F.concat(acc, F.sequence(h["start"], h["start"] - h["neg"] - 1))),
    )
    return ordered.select(text, picked.alias("brand_positions"))
