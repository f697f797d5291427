"""The cascade: direction, rules, knowledge base, models. First answer wins."""

from __future__ import annotations

from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.cleaning import with_clean
from spendlens.functions.names import enriched_text
from spendlens.functions.routing import (
    descriptor_override,
    direct_confidence,
    direct_gate,
    enrich_gate,
    needs_review,
    second_opinion,
)
from spendlens.functions.rows import settled
from spendlens.functions.rules import Rule, detect_direction, match_rules
from spendlens.functions.tokens import analyze
from spendlens.operators.embedding import Encoder
from spendlens.operators.fusion import PairScorer
from spendlens.options import DEFAULTS, Options
from spendlens.plans.search import Knowledge, search
from spendlens.session import cut_lineage


class TextModel(Protocol):
    """Adds `category` and `confidence` for a text column, one row in, one row out."""

    def score(self, df: DataFrame, text: str) -> DataFrame: ...


class Stage(NamedTuple):
    name: str
    model: TextModel


def quick_stages(df: DataFrame, text: str, rules: list[Rule] | None = None, options: Options = DEFAULTS) -> DataFrame:
    """Cleaned text and the answer of direction and rules, without a shuffle."""
    cleaned = with_clean(df, text)
    judged = cleaned.withColumn("_d", detect_direction(F.col(text), options)).withColumn(
        "_r", match_rules(F.col("cleaned"), rules, options)
    )
    return settled(
        judged,
        [c for c in cleaned.columns if c not in ("category", "confidence", "source")],
        category=F.coalesce("_d.category", "_r.category"),
        confidence=F.coalesce("_d.confidence", "_r.confidence"),
        source=F.when(F.col("_d").isNotNull(), "direction").when(F.col("_r").isNotNull(), "rules"),
    )


def first_available(stages: list[Stage | None]) -> Stage | None:
    """The best available model: the list is in order of preference."""
    return next((s for s in stages if s is not None and s.model is not None), None)


def knowledge_answers(
    texts: DataFrame,
    kb: Knowledge | None,
    scorer: PairScorer | str | None = None,
    encoder: Encoder | None = None,
    options: Options = DEFAULTS,
) -> DataFrame:
    """Per distinct cleaned text: a direct answer or the text for the model.

    Columns: cleaned, category, confidence, source, model_text, enriched.
    """
    if kb is None:
        context = F.col("decomposed.descriptor_context") if options.use_tokens else F.lit("")
        none = F.lit(None).cast("string")
        return analyze(texts.select("cleaned").distinct(), "cleaned").select(
            "cleaned",
            none.alias("category"),
            F.lit(None).cast("double").alias("confidence"),
            none.alias("source"),
            enriched_text(F.col("cleaned"), none, none, none, F.lit(None).cast("array<string>"), context).alias("model_text"),
            F.lit(False).alias("enriched"),
        )
    found = search(
        texts.select(F.col("cleaned").alias("text")), kb, options.use_tokens, scorer, encoder, options
    )
    record = kb.entries.select(
        F.col("entry_id").alias("_entry"),
        "canonical_name",
        "display_name",
        "mapped_category",
        "mapping_confidence",
        "metadata_text",
        "raw_category_labels",
    )
    joined = found.join(record, found["entry_id"] == record["_entry"], "left")
    context = F.col("decomposed.descriptor_context") if options.use_tokens else F.lit("")
    direct = direct_gate(
        F.col("strategy"), F.col("similarity"), F.col("mapping_confidence"), F.col("mapped_category"), options
    )
    enrich = enrich_gate(F.col("strategy"), F.col("similarity"), F.col("metadata_text"), options)
    judged = joined.withColumn("direct", direct).withColumn("enriched", ~F.col("direct") & enrich)

    def when_enriched(name: str):
        return F.when(F.col("enriched"), F.col(name))

    return judged.select(
        F.col("text").alias("cleaned"),
        F.when(
            F.col("direct"), F.coalesce(descriptor_override(context, F.col("mapped_category")), F.col("mapped_category"))
        ).alias("category"),
        F.when(F.col("direct"), direct_confidence(F.col("similarity"), options)).alias("confidence"),
        F.when(F.col("direct"), F.lit("knowledge_base")).alias("source"),
        enriched_text(
            F.col("text"),
            when_enriched("display_name"),
            when_enriched("canonical_name"),
            when_enriched("metadata_text"),
            when_enriched("raw_category_labels"),
            context,
        ).alias("model_text"),
        "enriched",
    )


def model_answers(
    texts: DataFrame, stage: Stage, second: Stage | None = None, options: Options = DEFAULTS
) -> DataFrame:
    """Scored texts: `model_text` in, category, confidence and source out."""
    scored = stage.model.score(texts, "model_text")
    source = F.when(F.col("enriched"), F.lit(f"{stage.name}_metadata")).otherwise(F.lit(stage.name))
    scored = scored.withColumn("source", source)
    if second is None or not options.use_second_opinion:
        return scored
    weak = F.col("confidence") < options.second_opinion_threshold
    asked = scored.where(weak).select(
        "cleaned",
        "enriched",
        "model_text",
        F.col("category").alias("_c"),
        F.col("confidence").alias("_p"),
        F.col("source").alias("_s"),
    )
    answered = second.model.score(asked, "model_text").withColumn(
        "_o", second_opinion(F.col("_c"), F.col("_p"), F.col("category"), F.col("confidence"), options)
    )
    settled = answered.select(
        "cleaned",
        "enriched",
        "model_text",
        F.col("_o.category").alias("category"),
        F.col("_o.confidence").alias("confidence"),
        F.when(F.col("_o.changed"), F.lit(second.name)).otherwise(F.col("_s")).alias("source"),
    )
    return scored.where(~weak).select(*settled.columns).unionByName(settled)


def classify(
    df: DataFrame,
    text: str = "description",
    rules: list[Rule] | None = None,
    kb: Knowledge | None = None,
    stages: list[Stage | None] | None = None,
    second: Stage | None = None,
    scorer: PairScorer | str | None = None,
    encoder: Encoder | None = None,
    options: Options = DEFAULTS,
) -> DataFrame:
    """Every input row with cleaned, category, confidence, source, flagged_for_review.

    The knowledge base and the models see each unresolved cleaned text once;
    answers are joined back to the rows. Rows no stage answers keep nulls and
    are flagged. The cleaned rows feed several scans, so they are written once.
    """
    quick = quick_stages(df, text, rules, options)
    stage = first_available(stages or [])
    if kb is None and stage is None:
        return quick.withColumn("flagged_for_review", F.col("category").isNull())
    quick = cut_lineage(quick)
    open_texts = quick.where(F.col("category").isNull()).select("cleaned").distinct()
    answers = knowledge_answers(open_texts.where(F.col("cleaned") != ""), kb, scorer, encoder, options)
    if stage is not None:
        none = F.lit(None).cast("string")
        blank = open_texts.where(F.col("cleaned") == "").select(
            "cleaned",
            none.alias("category"),
            F.lit(None).cast("double").alias("confidence"),
            none.alias("source"),
            F.col("cleaned").alias("model_text"),
            F.lit(False).alias("enriched"),
        )
        answers = answers.unionByName(blank).persist()
        columns = ["cleaned", "category", "confidence", "source"]
        direct = answers.where(F.col("category").isNotNull()).select(*columns)
        unresolved = answers.where(F.col("category").isNull()).select("cleaned", "model_text", "enriched")
        answers = direct.unionByName(model_answers(unresolved, stage, second, options).select(*columns))
    side = answers.select(
        F.col("cleaned").alias("_cleaned"),
        F.col("category").alias("_category"),
        F.col("confidence").alias("_confidence"),
        F.col("source").alias("_source"),
    )
    # Rows already answered skip the join; a null key would pile them up in one task.
    columns = [c for c in quick.columns if c not in ("category", "confidence", "source")]
    joined = (
        quick.where(F.col("category").isNull())
        .join(side, F.col("cleaned") == F.col("_cleaned"), "left")
        .select(
            *columns,
            F.col("_category").alias("category"),
            F.col("_confidence").alias("confidence"),
            F.col("_source").alias("source"),
        )
    )
    done = quick.where(F.col("category").isNotNull()).select(*columns, "category", "confidence", "source")
    trusted = F.col("source").isin("direction", "rules", "knowledge_base")
    flagged = (
        F.when(F.col("category").isNull() | (F.col("cleaned") == ""), F.lit(True))
        .when(trusted, F.lit(False))
        .otherwise(needs_review(F.col("confidence"), options))
    )
    return done.unionByName(joined).withColumn("flagged_for_review", flagged)
