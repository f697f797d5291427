"""Token roles of a cleaned text: brand, descriptor, location, noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.fixed import DESCRIPTOR_PHRASES, DESCRIPTOR_WORDS, LOCATIONS, NOISE_PATTERN
from spendlens.functions.rows import settled


def tokenize(text: Column) -> Column:
    """Upper-cased words; an empty array for blank text."""
    upper = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    return F.filter(F.split(upper, r"\s+"), lambda t: t != "")


def positions(tokens: Column) -> Column:
    return F.transform(tokens, lambda t, i: i + 1)


def phrase_starts(tokens: Column, phrase: str, hint: str) -> Column:
    first, second = phrase.split()
    starts = F.filter(
        positions(tokens),
        lambda i: (F.get(tokens, i - 1) == first) & F.coalesce(F.get(tokens, i) == second, F.lit(False)),
    )
    return F.transform(
        starts,
        lambda i: F.struct(i.alias("start"), F.lit(phrase).alias("phrase"), F.lit(hint).alias("hint")),
    )


def phrase_hits(tokens: Column) -> Column:
    """Struct array (start, phrase, hint), phrases in table order then by position."""
    return F.flatten(F.array(*[phrase_starts(tokens, p, h) for p, h in DESCRIPTOR_PHRASES.items()]))


def phrase_positions(hits: Column) -> Column:
    return F.flatten(F.transform(hits, lambda h: F.array(h["start"], h["start"] + 1)))


def hint_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in DESCRIPTOR_WORDS.items() for x in pair])


def word_hint(token: Column) -> Column:
    """Hint of a word, retried without trailing dots and apostrophes."""
    table = hint_map()
    return F.coalesce(
        F.try_element_at(table, token),
        F.try_element_at(table, F.regexp_replace(token, r"[.']+$", "")),
    )


def token_roles(tokens: Column, hits: Column, brand_positions: Column | None = None) -> Column:
    """Struct array (token, role, hint) in token order, phrase parts last."""
    taken = phrase_positions(hits)
    branded = F.array().cast("array<int>") if brand_positions is None else brand_positions
    free = F.filter(positions(tokens), lambda i: ~F.array_contains(taken, i))

    def judge(i: Column) -> Column:
        token = F.get(tokens, i - 1)
        hint = word_hint(token)
        role = (
            F.when(F.array_contains(branded, i), "brand")
            .when(token.rlike(NOISE_PATTERN), "noise")
            .when(token.isin(*LOCATIONS), "location")
            .when(hint.isNotNull(), "descriptor")
            .otherwise("brand")
        )
        return F.struct(
            token.alias("token"), role.alias("role"), F.when(role == "descriptor", hint).alias("hint")
        )

    singles = F.transform(free, judge)
    parts = F.flatten(
        F.transform(
            hits,
            lambda h: F.transform(
                F.split(h["phrase"], " "),
                lambda w: F.struct(
                    w.alias("token"), F.lit("descriptor").alias("role"), h["hint"].alias("hint")
                ),
            ),
        )
    )
    return F.concat(singles, parts)


def tokens_with_role(roles: Column, role: str) -> Column:
    return F.transform(F.filter(roles, lambda r: r["role"] == role), lambda r: r["token"])


def analyze(df: DataFrame, text: str, out: str = "decomposed", brands: str | None = None) -> DataFrame:
    """Adds a struct with the role of every token, the brand query and the hints.

    `brands` names a column with the 1-based positions of words known to be part
    of a multi-word brand (see operators.exact). Words, phrase hits and roles
    are columns of their own on the way, so each is computed once per row. A
    filter on the result stays above it: pushed below a distinct or a join it
    would repeat the whole analysis for every row there.
    """
    kept = df.columns
    named = df.withColumn("_words", tokenize(F.col(text)))
    found = named.withColumn("_hits", phrase_hits(F.col("_words")))
    branded = None if brands is None else F.coalesce(F.col(brands), F.array().cast("array<int>"))
    judged = found.withColumn("_roles", token_roles(F.col("_words"), F.col("_hits"), branded))
    brand = tokens_with_role(F.col("_roles"), "brand")
    listed = judged.withColumn("_brand", brand).withColumn(
        "_hints",
        F.array_distinct(
            F.concat(
                F.transform("_hits", lambda h: h["hint"]),
                F.filter(F.transform("_roles", lambda r: r["hint"]), lambda h: h.isNotNull()),
            )
        ),
    )
    brand_query = (
        F.when(F.size("_words") == 0, F.lit(""))
        .when(F.size("_brand") > 0, F.concat_ws(" ", "_brand"))
        .otherwise(F.col(text))
    )
    decomposed = F.struct(
        F.col("_roles").alias("token_roles"),
        F.col("_brand").alias("brand_tokens"),
        tokens_with_role(F.col("_roles"), "descriptor").alias("descriptor_tokens"),
        tokens_with_role(F.col("_roles"), "location").alias("location_tokens"),
        tokens_with_role(F.col("_roles"), "noise").alias("noise_tokens"),
        brand_query.alias("brand_query"),
        F.concat_ws("; ", "_hints").alias("descriptor_context"),
    )
    return settled(listed, kept, **{out: decomposed})
