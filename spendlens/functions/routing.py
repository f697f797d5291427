"""Gates that decide what a match may do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlens.fixed import CATEGORIES, OVERRIDE_HINTS
from spendlens.options import DEFAULTS, Options


def direct_gate(
    strategy: Column, similarity: Column, mapping_confidence: Column, category: Column, options: Options = DEFAULTS
) -> Column:
    """May the match name the category by itself?"""
    return F.coalesce(
        (strategy != "rerank")
        & (similarity >= options.direct_similarity)
        & (mapping_confidence >= options.direct_mapping_confidence)
        & category.isNotNull(),
        F.lit(False),
    )


def enrich_gate(strategy: Column, similarity: Column, metadata: Column, options: Options = DEFAULTS) -> Column:
    """May the match's metadata join the model text?"""
    needed = F.when(strategy == "dense_lexical", options.enrich_fallback_similarity).otherwise(
        options.enrich_similarity
    )
    return F.coalesce((similarity >= needed) & (metadata != ""), F.lit(False))


def descriptor_override(descriptor_context: Column, category: Column) -> Column:
    """Category of the first decisive hint, null when it agrees or there is none."""
    table = F.create_map(*[F.lit(x) for pair in OVERRIDE_HINTS.items() for x in pair])
    hints = F.split(F.coalesce(descriptor_context, F.lit("")), "; ")
    named = F.filter(F.transform(hints, lambda h: F.try_element_at(table, h)), lambda c: c.isNotNull())
    decided = F.get(named, F.lit(0))
    return F.when(~decided.eqNullSafe(category), decided)


def direct_confidence(similarity: Column, options: Options = DEFAULTS) -> Column:
    return F.least(similarity, F.lit(options.direct_confidence_cap))


def needs_review(confidence: Column, options: Options = DEFAULTS) -> Column:
    return confidence < options.review_threshold


def is_category(label: Column) -> Column:
    """Is the label one of the known categories? False for null and blank."""
    return F.coalesce(label.isin(*CATEGORIES), F.lit(False))


def second_opinion(
    category: Column, confidence: Column, other_category: Column, other_confidence: Column, options: Options = DEFAULTS
) -> Column:
    """Struct (category, confidence, changed): a weak answer yields to a strong second one."""
    take = F.coalesce(
        (confidence < options.second_opinion_threshold)
        & (other_confidence >= options.second_opinion_threshold),
        F.lit(False),
    )
    return F.struct(
        F.when(take, other_category).otherwise(category).alias("category"),
        F.when(take, other_confidence).otherwise(confidence).alias("confidence"),
        take.alias("changed"),
    )
