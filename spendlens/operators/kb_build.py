"""Knowledge-base entries from place rows and seed merchants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.cleaning import blank_to_null, clean_text, with_clean
from spendlens.functions.labels import map_labels
from spendlens.functions.names import (
    alias_variants,
    clean_aliases,
    drop_last_word,
    metadata_text,
    place_aliases,
    search_document,
    seed_aliases,
    stable_id,
    strings,
)
from spendlens.functions.rows import exploded, posexploded
from spendlens.operators.ranking import most_frequent
from spendlens.seeds import SEED_SOURCE, SEEDS

PLACE_SOURCE = "foursquare"
COUNTRY = "CA"
KEPT_LABELS = 8

ENTRY_COLUMNS = [
    "entry_id", "canonical_name", "display_name", "mapped_category", "mapping_confidence",
    "metadata_text", "source", "raw_category_labels", "locality", "region", "country",
    "document", "aliases",
]


def seed_table(spark: SparkSession) -> DataFrame:
    rows = [(i, *seed, SEED_SOURCE) for i, seed in enumerate(SEEDS)]
    return spark.createDataFrame(
        rows,
        "position long, canonical_name string, aliases array<string>, mapped_category string,"
        " mapping_confidence double, metadata_text string, source string",
    )


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """A column when present, else a null of that type."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def place_entries(places: DataFrame, order: str = "position") -> DataFrame:
    """Place rows to entries; names under 3 characters go.

    Input: name, locality, region, labels (array), and a unique `order` column.
    """
    named = with_clean(places, "name", "canonical_name").select(
        F.col(order).alias("position"),
        "canonical_name",
        blank_to_null(F.col("name")).alias("display_name"),
        F.col("locality"),
        F.col("region"),
        F.coalesce(F.col("labels"), F.array().cast("array<string>")).alias("labels"),
    ).where(F.length("canonical_name") >= 3)
    mapped = map_labels(named, "labels", "m").select(
        "*",
        place_aliases(F.col("canonical_name"), F.col("display_name")).alias("ranked"),
        metadata_text(F.col("labels"), F.col("locality"), F.col("region"), F.lit(COUNTRY)).alias("metadata_text"),
        F.slice("labels", 1, KEPT_LABELS).alias("raw_category_labels"),
    )
    return mapped.select(
        "position",
        stable_id(F.lit(PLACE_SOURCE), F.col("canonical_name")).alias("entry_id"),
        "canonical_name",
        "display_name",
        F.col("m.category").alias("mapped_category"),
        F.col("m.confidence").alias("mapping_confidence"),
        "metadata_text",
        F.lit(PLACE_SOURCE).alias("source"),
        "raw_category_labels",
        "locality",
        "region",
        F.lit(COUNTRY).alias("country"),
        search_document(
            F.col("display_name"),
            F.col("canonical_name"),
            F.transform("ranked", lambda a: a["alias"]),
            F.lit(None).cast("array<string>"),
            F.col("metadata_text"),
            F.col("raw_category_labels"),
            F.col("locality"),
            F.col("region"),
            F.lit(COUNTRY),
        ).alias("document"),
        F.col("ranked").alias("aliases"),
    )


def seed_entries(seeds: DataFrame) -> DataFrame:
    """Seed merchants to entries; the same columns as place_entries."""
    strings_type = "array<string>"
    source = F.coalesce(blank_to_null(optional(seeds, "source", "string")), F.lit(SEED_SOURCE))
    named = seeds.select(
        "position",
        clean_text(F.col("canonical_name")).alias("canonical_name"),
        F.col("aliases").alias("listed"),
        optional(seeds, "stripped_aliases", strings_type).alias("alternates"),
        F.col("mapped_category"),
        F.coalesce(F.col("mapping_confidence"), F.lit(0.0)).alias("mapping_confidence"),
        F.trim(F.coalesce(F.col("metadata_text"), F.lit(""))).alias("metadata_text"),
        source.alias("source"),
        F.filter(
            F.transform(strings(optional(seeds, "raw_category_labels", strings_type)), lambda v: F.trim(v)),
            lambda v: v != "",
        ).alias("raw_category_labels"),
        *[
            blank_to_null(optional(seeds, name, "string")).alias(name)
            for name in ("display_name", "locality", "region", "country")
        ],
    ).where(F.length("canonical_name") >= 3)
    ranked = named.withColumn(
        "ranked", seed_aliases(F.col("canonical_name"), F.col("listed"), F.col("alternates"))
    )
    return ranked.select(
        "position",
        stable_id(F.col("source"), F.col("canonical_name")).alias("entry_id"),
        "canonical_name",
        "display_name",
        "mapped_category",
        "mapping_confidence",
        "metadata_text",
        "source",
        "raw_category_labels",
        "locality",
        "region",
        "country",
        search_document(
            F.col("display_name"),
            F.col("canonical_name"),
            F.transform("ranked", lambda a: a["alias"]),
            F.filter(
                F.transform(strings(F.col("alternates")), clean_text), lambda a: a != ""
            ),
            F.col("metadata_text"),
            F.col("raw_category_labels"),
            F.col("locality"),
            F.col("region"),
            F.col("country"),
        ).alias("document"),
        F.col("ranked").alias("aliases"),
    )


def first_entries(seeds: DataFrame, places: DataFrame) -> DataFrame:
    """One entry per canonical name: seeds before places, then by position.

    `copies` counts the rows that shared the name.
    """
    both = seeds.withColumn("_rank", F.lit(0)).unionByName(places.withColumn("_rank", F.lit(1)))
    rest = [c for c in ENTRY_COLUMNS if c != "canonical_name"]
    picked = both.groupBy("canonical_name").agg(
        F.min_by(F.struct(*rest), F.struct("_rank", "position")).alias("_row"),
        F.count("*").alias("copies"),
    )
    return picked.select("_row.*", "canonical_name", "copies").select(*ENTRY_COLUMNS, "copies")


def duplicate_count(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count("*").alias("kept"),
        F.sum("copies").alias("scanned"),
        (F.sum("copies") - F.count("*")).alias("duplicates"),
    )


def alias_table(entries: DataFrame) -> DataFrame:
    """Unique (alias, entry_id) with the highest priority."""
    return (
        exploded(entries, ["entry_id"], "aliases", "a")
        .groupBy(F.col("a.alias").alias("alias"), "entry_id")
        .agg(F.max("a.priority").alias("priority"))
    )


def restrict_to_candidates(places: DataFrame, candidates: DataFrame) -> DataFrame:
    """Places whose cleaned name is a candidate name (`name` column)."""
    keyed = with_clean(places, "name", "canonical_name")
    wanted = candidates.select(F.col("name").alias("_wanted")).distinct()
    return keyed.join(wanted, F.col("canonical_name") == F.col("_wanted"), "left_semi")


def named_places(places: DataFrame, order: str = "position") -> DataFrame:
    """Place rows keyed by cleaned name with trimmed optional fields."""
    return with_clean(places, "name", "canonical_name").select(
        "canonical_name",
        F.col(order).alias("position"),
        blank_to_null(F.col("name")).alias("display_name"),
        blank_to_null(F.col("locality")).alias("locality"),
        blank_to_null(F.col("region")).alias("region"),
        F.transform(
            F.filter(strings(F.col("labels")), lambda v: v != ""), lambda v: F.trim(v)
        ).alias("labels"),
    )


def label_rows(named: DataFrame) -> DataFrame:
    """One row per (place, label) with a running order for first-seen ties."""
    rows = posexploded(named, ["canonical_name", "position"], "labels", "label_pos", "label")
    return rows.withColumn("seen", F.struct("position", "label_pos"))


def category_shares(named: DataFrame) -> DataFrame:
    """Summed mapper confidence by (canonical_name, category)."""
    mapped = map_labels(named.select("canonical_name", "position", "labels"), "labels", "m")
    return (
        mapped.where(F.col("m.category").isNotNull() & (F.col("m.confidence") > 0))
        .groupBy("canonical_name", F.col("m.category").alias("category"))
        .agg(F.sum("m.confidence").alias("score"), F.min("position").alias("seen"))
    )


def best_category(shares: DataFrame) -> DataFrame:
    """Category of the highest summed confidence and its share of the total."""
    rounded = F.round("score", 9)
    return shares.groupBy("canonical_name").agg(
        F.max_by("category", F.struct(rounded, -F.col("seen"))).alias("mapped_category"),
        (F.max("score") / F.sum("score")).alias("mapping_confidence"),
    )


def in_rank_order(ranked: DataFrame, value: str, out: str) -> DataFrame:
    """Ranked values of a key as one short array (n per key at most)."""
    return ranked.groupBy("canonical_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", value))), lambda s: s[value]
        ).alias(out)
    )


def grouped_entries(named: DataFrame) -> DataFrame:
    """One entry per cleaned name from all its places: modes, top labels, best category."""
    labels = in_rank_order(
        most_frequent(label_rows(named), ["canonical_name"], "label", 3, "seen"), "label", "labels"
    )
    names = in_rank_order(
        most_frequent(
            named.where(F.col("display_name").isNotNull()), ["canonical_name"], "display_name", 5, "position"
        ),
        "display_name",
        "names",
    )
    locality = mode_of(named, "locality")
    region = mode_of(named, "region")
    joined = named.select("canonical_name").distinct()
    for side in (labels, names, locality, region, best_category(category_shares(named))):
        joined = joined.join(side, "canonical_name", "left")
    filled = joined.select(
        "canonical_name",
        strings(F.col("labels")).alias("raw_category_labels"),
        strings(F.col("names")).alias("raw_aliases"),
        "locality",
        "region",
        "mapped_category",
        F.coalesce("mapping_confidence", F.lit(0.0)).alias("mapping_confidence"),
    )
    return filled.select(
        "canonical_name",
        F.get("raw_aliases", F.lit(0)).alias("display_name"),
        alias_variants(F.concat(F.array("canonical_name"), F.col("raw_aliases"))).alias("aliases"),
        alias_variants(
            F.transform("raw_aliases", lambda n: drop_last_word(clean_text(n)))
        ).alias("stripped_aliases"),
        "raw_aliases",
        "mapped_category",
        "mapping_confidence",
        metadata_text(
            F.col("raw_category_labels"), F.col("locality"), F.col("region"), F.lit(COUNTRY)
        ).alias("metadata_text"),
        F.lit(PLACE_SOURCE).alias("source"),
        "raw_category_labels",
        "locality",
        "region",
        F.lit(COUNTRY).alias("country"),
    )


def mode_of(named: DataFrame, value: str) -> DataFrame:
    counts = (
        named.where(F.col(value).isNotNull())
        .groupBy("canonical_name", value)
        .agg(F.count("*").alias("n"), F.min("position").alias("seen"))
    )
    return counts.groupBy("canonical_name").agg(
        F.max_by(value, F.struct("n", -F.col("seen"))).alias(value)
    )


def merge_entries(rows: DataFrame) -> DataFrame:
    """Rows of one canonical name merged, earlier rows (`position`) first.

    Set values are exploded and made distinct before they are collected, so a
    hot name collects its distinct aliases and labels, not its rows.
    """
    strings_type = "array<string>"
    text = lambda name: blank_to_null(optional(rows, name, "string")).alias(name)
    aliases = clean_aliases(F.col("aliases"))
    canonical = clean_text(F.col("canonical_name"))
    keyed = rows.select(
        "position",
        canonical.alias("_name"),
        F.when(
            (canonical != "") & ~F.array_contains(aliases, canonical),
            F.concat(F.array(canonical), aliases),
        ).otherwise(aliases).alias("aliases"),
        clean_aliases(optional(rows, "stripped_aliases", strings_type)).alias("stripped_aliases"),
        F.filter(
            F.transform(strings(optional(rows, "raw_aliases", strings_type)), lambda v: F.trim(v)), lambda v: v != ""
        ).alias("raw_aliases"),
        strings(optional(rows, "raw_category_labels", strings_type)).alias("raw_category_labels"),
        "mapped_category",
        F.coalesce("mapping_confidence", F.lit(0.0)).alias("mapping_confidence"),
        *[text(n) for n in ("display_name", "metadata_text", "source", "locality", "region", "country")],
    ).where(F.size("aliases") > 0)
    keyed = keyed.withColumn(
        "canonical_name", F.coalesce(blank_to_null(F.col("_name")), F.col("aliases")[0])
    ).drop("_name")

    def earliest(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("position"))).alias(name)

    scalars = keyed.groupBy("canonical_name").agg(
        F.count("*").alias("merged"),
        earliest("display_name"),
        earliest("locality"),
        earliest("region"),
        earliest("country"),
        F.min_by("source", "position").alias("source"),
        F.min_by("raw_category_labels", "position").alias("_own_labels"),
        F.max_by(
            F.struct("mapped_category"), F.struct("mapping_confidence", -F.col("position"))
        )["mapped_category"].alias("mapped_category"),
        F.max("mapping_confidence").alias("mapping_confidence"),
    )
    out = scalars
    for name in ("aliases", "stripped_aliases", "raw_aliases"):
        out = out.join(merged_set(keyed, name), "canonical_name", "left").withColumn(
            name, strings(F.col(name))
        )
    # A row that met no other keeps its labels as they are, repeats included.
    out = out.join(ordered_set(keyed, "raw_category_labels"), "canonical_name", "left").withColumn(
        "raw_category_labels",
        F.when(F.col("merged") == 1, F.col("_own_labels")).otherwise(strings(F.col("raw_category_labels"))),
    ).drop("_own_labels")
    out = out.join(joined_texts(keyed, "metadata_text"), "canonical_name", "left")
    return out.withColumn("metadata_text", F.coalesce("metadata_text", F.lit("")))


def merged_set(keyed: DataFrame, name: str) -> DataFrame:
    """Union of a list column, sorted once two rows or more were merged."""
    items = posexploded(keyed, ["canonical_name", "position"], name, "i", "v")
    distinct = items.groupBy("canonical_name", "v").agg(F.min(F.struct("position", "i")).alias("at"))
    counts = keyed.groupBy("canonical_name").agg(F.count("*").alias("rows"))
    collected = distinct.groupBy("canonical_name").agg(
        F.array_sort(F.collect_list(F.struct("at", "v"))).alias("pairs")
    )
    values = F.transform("pairs", lambda p: p["v"])
    return collected.join(counts, "canonical_name").select(
        "canonical_name",
        F.when(F.col("rows") > 1, F.array_sort(values)).otherwise(values).alias(name),
    )


def ordered_set(keyed: DataFrame, name: str) -> DataFrame:
    """Union of a list column in order of first appearance."""
    items = posexploded(keyed, ["canonical_name", "position"], name, "i", "v")
    distinct = items.groupBy("canonical_name", "v").agg(F.min(F.struct("position", "i")).alias("at"))
    return distinct.groupBy("canonical_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]
        ).alias(name)
    )


def joined_texts(keyed: DataFrame, name: str) -> DataFrame:
    """Non-blank texts in row order, joined by a full stop."""
    return (
        keyed.where(F.col(name).isNotNull())
        .groupBy("canonical_name")
        .agg(
            F.concat_ws(
                ". ",
                F.transform(
                    F.array_sort(F.collect_list(F.struct("position", name))), lambda p: p[name]
                ),
            ).alias(name)
        )
    )


def remap_categories(entries: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Entries with labels mapped again; `change` tells what happened to each."""
    has_labels = F.size(strings(F.col("raw_category_labels"))) > 0
    mapped = map_labels(entries, "raw_category_labels", "_new")
    old, new = F.col("mapped_category"), F.col("_new.category")
    old_confidence = F.coalesce("mapping_confidence", F.lit(0.0))
    moved = F.abs(F.col("_new.confidence") - old_confidence) > tolerance
    updated = has_labels & (~old.eqNullSafe(new) | moved)
    change = (
        F.when(~updated, F.lit("kept"))
        .when(old.isNull() & new.isNotNull(), F.lit("gained"))
        .when(old.isNotNull() & new.isNull(), F.lit("lost"))
        .when(old != new, F.lit("changed"))
        .otherwise(F.lit("confidence"))
    )
    return (
        mapped.withColumn("change", change)
        .withColumn("before_category", old)
        .withColumn("mapped_category", F.when(F.col("change") == "kept", old).otherwise(new))
        .withColumn(
            "mapping_confidence",
            F.when(F.col("change") == "kept", F.col("mapping_confidence")).otherwise(F.col("_new.confidence")),
        )
        .drop("_new")
    )


def remap_report(remapped: DataFrame) -> DataFrame:
    return remapped.agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("change") != "kept").alias("updated"),
        F.count_if(F.col("change") == "gained").alias("gained"),
        F.count_if(F.col("change") == "lost").alias("lost"),
        F.count_if(F.col("change") == "changed").alias("changed"),
        F.count("before_category").alias("mapped_before"),
        F.count("mapped_category").alias("mapped_after"),
    )


def kb_profile(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count("*").alias("entries"),
        F.count_if(F.size(strings(F.col("raw_category_labels"))) > 0).alias("with_labels"),
        F.count("mapped_category").alias("with_category"),
    )
