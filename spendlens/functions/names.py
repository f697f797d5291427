"""Alias, id and document expressions for merchant names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlens.functions.cleaning import blank_to_null, clean_text


def strings(col: Column) -> Column:
    """A null-safe array of strings."""
    return F.coalesce(col, F.array().cast("array<string>"))


def clean_aliases(aliases: Column) -> Column:
    """Cleaned, non-empty, first occurrence kept."""
    cleaned = F.transform(strings(aliases), clean_text)
    return F.array_distinct(F.filter(cleaned, lambda a: a != ""))


def drop_last_word(cleaned: Column) -> Column:
    """All words but the last; blank for a single word."""
    return F.regexp_extract(cleaned, r"^(.*\S)\s+\S+$", 1)


def alias_variants(values: Column) -> Column:
    """Each cleaned value followed by itself without its last word (3+ chars)."""
    cleaned = F.filter(F.transform(strings(values), clean_text), lambda a: a != "")
    pairs = F.transform(cleaned, lambda a: F.array(a, drop_last_word(a)))
    kept = F.transform(
        pairs,
        lambda p: F.when(F.length(p[1]) >= 3, p).otherwise(F.slice(p, 1, 1)),
    )
    return F.array_distinct(F.flatten(kept))


def with_priority(values: Column, priority: int) -> Column:
    return F.transform(
        strings(values), lambda v: F.struct(v.alias("alias"), F.lit(priority).alias("priority"))
    )


def ranked_aliases(groups: list[tuple[int, Column]]) -> Column:
    """Struct array (alias, priority): values cleaned, 3+ chars, first group wins."""
    listed = F.concat(*[with_priority(values, p) for p, values in groups])
    pairs = F.transform(listed, lambda p: F.struct(clean_text(p["alias"]).alias("alias"), p["priority"].alias("priority")))
    pairs = F.filter(pairs, lambda p: F.length(p["alias"]) >= 3)
    return F.aggregate(
        pairs,
        F.array().cast("array<struct<alias:string,priority:int>>"),
        lambda acc, p: F.when(F.exists(acc, lambda a: a["alias"] == p["alias"]), acc).otherwise(
            F.concat(acc, F.array(p))
        ),
    )


def place_aliases(canonical: Column, display: Column) -> Column:
    """Canonical 100, display name 90, canonical without a short or numeric last word 75."""
    last = F.element_at(F.split(canonical, r"\s+"), -1)
    shortened = F.when(
        last.rlike(r"^[0-9]+$") | (F.length(last) <= 2), blank_to_null(drop_last_word(canonical))
    )
    return ranked_aliases(
        [(100, F.array(canonical)), (90, F.array(display)), (75, F.array(shortened))]
    )


def seed_aliases(canonical: Column, aliases: Column, alternates: Column) -> Column:
    """Canonical 100, listed aliases 95, alternate forms 80."""
    return ranked_aliases([(100, F.array(canonical)), (95, aliases), (80, alternates)])


def stable_id(source: Column, canonical: Column) -> Column:
    digest = F.sha1(F.concat(source, F.lit(":"), canonical))
    return F.concat(source, F.lit(":"), F.substring(digest, 1, 16))


def location_text(*parts: Column) -> Column:
    """Non-blank parts joined by commas, null when there are none."""
    joined = F.concat_ws(", ", *[F.when(p != "", p) for p in parts])
    return F.when(joined != "", F.concat(F.lit("location: "), joined))


def first_joined(values: Column, n: int, separator: str, prefix: str) -> Column:
    """`prefix` and the first n values, null for an empty list."""
    values = strings(values)
    return F.when(
        F.size(values) > 0, F.concat(F.lit(prefix), F.concat_ws(separator, F.slice(values, 1, n)))
    )


def metadata_text(labels: Column, locality: Column, region: Column, country: Column) -> Column:
    return F.concat_ws(
        ". ", first_joined(labels, 3, "; ", "place types: "), location_text(locality, region, country)
    )


def prefixed(prefix: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(prefix), value))


def search_document(
    display: Column,
    canonical: Column,
    aliases: Column,
    alternates: Column,
    metadata: Column,
    labels: Column,
    locality: Column,
    region: Column,
    country: Column,
) -> Column:
    """The text that lexical and dense search index."""
    return F.concat_ws(
        ". ",
        prefixed("display name: ", display),
        prefixed("canonical name: ", canonical),
        first_joined(aliases, 12, " ; ", "aliases: "),
        first_joined(alternates, 12, " ; ", "alternate forms: "),
        prefixed("external metadata: ", metadata),
        first_joined(labels, 6, " ; ", "place types: "),
        location_text(locality, region, country),
    )


def enriched_text(
    cleaned: Column,
    display: Column,
    canonical: Column,
    metadata: Column,
    labels: Column,
    descriptor_context: Column,
) -> Column:
    """Model input: cleaned text, then what the match and the descriptors add.

    Pass null match columns for a text without a match.
    """
    identity = F.coalesce(F.when(display != "", display), canonical)
    return F.concat_ws(
        ". ",
        cleaned,
        F.when(identity != cleaned, prefixed("merchant identity: ", identity)),
        prefixed("external metadata: ", metadata),
        first_joined(labels, 3, "; ", "place types: "),
        prefixed("descriptor context: ", descriptor_context),
    )
