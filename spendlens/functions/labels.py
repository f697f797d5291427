"""Place label paths to categories, by weighted keyword hits, inside the row."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.fixed import (
    AUTOMOTIVE_KEYWORDS,
    GENERIC_KEYWORDS,
    LABEL_KEYWORDS,
    LABEL_SHARE,
)
from spendlens.functions.names import strings
from spendlens.functions.rows import settled


def prepare_labels(labels: Column) -> Column:
    """Upper-cased labels with their depth weight."""
    uppers = F.transform(strings(labels), F.upper)
    return F.transform(
        uppers,
        lambda u: F.struct(
            u.alias("text"),
            (F.lit(1.0) + (F.size(F.split(u, ">")) - 1) * F.lit(0.1)).alias("depth"),
        ),
    )


def keyword_weights(category: str) -> list[tuple[str, float]]:
    automotive = AUTOMOTIVE_KEYWORDS if category == "Transportation" else []
    return [(k, 2.0) for k in automotive] + [
        (k, 1.0 if k in GENERIC_KEYWORDS else 2.0) for k in LABEL_KEYWORDS[category]
    ]


def category_score(prepared: Column, category: str) -> Column:
    """Sum of depth x weight over labels and keywords, in list order.

    The keywords are one constant array that is looped over: a branch per
    keyword would not fit into a generated method.
    """
    rows = json.dumps([{"word": k, "weight": w} for k, w in keyword_weights(category)])
    table = F.from_json(F.lit(rows), "array<struct<word:string,weight:double>>")
    return F.aggregate(
        prepared,
        F.lit(0.0),
        lambda total, label: F.aggregate(
            table,
            total,
            lambda t, k: F.when(
                label["text"].contains(k["word"]), t + label["depth"] * k["weight"]
            ).otherwise(t),
        ),
    )


def any_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def first_label(prepared: Column, words: list[str]) -> Column:
    """1-based position of the first label holding any of the words, 0 if none."""
    return F.coalesce(
        F.array_position(F.transform(prepared, lambda x: x["text"].rlike(any_of(words))), True),
        F.lit(0),
    )


def score_order(prepared: Column, category: str) -> Column:
    """When the category first scored: label by label, automotive before the table."""
    places = list(LABEL_KEYWORDS)
    step = len(places) + 1
    table = first_label(prepared, LABEL_KEYWORDS[category]) * step + places.index(category) + 1
    if category != "Transportation":
        return table
    automotive = first_label(prepared, AUTOMOTIVE_KEYWORDS) * step
    return (
        F.when(automotive == 0, table)
        .when(first_label(prepared, LABEL_KEYWORDS[category]) == 0, automotive)
        .otherwise(F.least(table, automotive))
    )


def map_labels(df: DataFrame, labels: str, out: str = "mapped") -> DataFrame:
    """Adds struct (category, confidence): the best-scoring category and its share.

    A share below the limit keeps its confidence but names no category. Ties
    go to the category that scored first.
    """
    kept = [c for c in df.columns if c != out]
    prepared = df.withColumn("_prepared", prepare_labels(F.col(labels)))
    scored = prepared.withColumn(
        "_scored",
        F.array(
            *[
                F.struct(
                    score_order(F.col("_prepared"), c).alias("order"),
                    category_score(F.col("_prepared"), c).alias("score"),
                    F.lit(c).alias("category"),
                )
                for c in LABEL_KEYWORDS
            ]
        ),
    )
    # In order of first score: the total adds up, and ties fall, in that order.
    ranked = F.array_sort(F.filter("_scored", lambda s: s["score"] > 0))
    summary = F.aggregate(
        ranked,
        F.struct(
            F.lit(0.0).alias("total"),
            F.lit(0.0).alias("best"),
            F.lit(None).cast("string").alias("category"),
        ),
        lambda acc, s: F.struct(
            (acc["total"] + s["score"]).alias("total"),
            F.greatest(acc["best"], s["score"]).alias("best"),
            F.when(s["score"] > acc["best"], s["category"]).otherwise(acc["category"]).alias("category"),
        ),
    )
    totalled = scored.withColumn("_sum", summary)
    share = F.coalesce(F.col("_sum.best") / F.nullif(F.col("_sum.total"), F.lit(0.0)), F.lit(0.0))
    return settled(
        totalled,
        kept,
        **{
            out: F.struct(
                F.when(share >= LABEL_SHARE, F.col("_sum.category")).alias("category"), share.alias("confidence")
            )
        },
    )
