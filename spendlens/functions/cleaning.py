"""Description cleaning with built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.fixed import CLEAN_MARKERS, CLEAN_STEPS, PROVINCES
from spendlens.functions.rows import settled
from spendlens.functions.white import strip


def fold_case(text: Column) -> Column:
    """Null to blank, trimmed, sharp s spelled out, upper case."""
    return F.upper(F.replace(strip(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")))


def needed_word(pattern: str) -> str | None:
    """A literal every match of a plain upper-case pattern must contain, if one is obvious."""
    bare = re.sub(r"\\.", " ", pattern)
    while re.search(r"\([^()]*\)", bare):
        bare = re.sub(r"\([^()]*\)[?*]?", " ", bare)
    if "|" in bare:
        return None
    bare = re.sub(r"\[[^\]]*\]", " ", bare)
    bare = re.sub(r"[A-Z][?*{]", " ", bare)
    words = re.findall(r"[A-Z]{3,}", bare)
    return max(words, key=len) if words else None


def guarded_rlike(text: Column, pattern: str) -> Column:
    """rlike behind a cheap test for the literal the pattern needs.

    Patterns anchored at the start fail fast by themselves.
    """
    word = None if pattern.startswith("^") else needed_word(pattern)
    return text.rlike(pattern) if word is None else text.contains(word) & text.rlike(pattern)


def replace_steps(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def marker(folded: Column) -> Column:
    """Marker that stands for the whole text, null when none matches."""
    found = None
    for pattern, name in CLEAN_MARKERS:
        hit = F.when if found is None else found.when
        found = hit(guarded_rlike(folded, pattern), F.lit(name))
    return found


def clean_text(text: Column) -> Column:
    """Cleaned description: a marker when one matches, else the stripped text.

    One expression, for use inside arrays. For a column of rows `with_clean`
    gives the same and skips the steps a text does not need.
    """
    folded = fold_case(text)
    return F.coalesce(marker(folded), strip(replace_steps(folded, CLEAN_STEPS)))


PREFIX_STEPS = [step for step in CLEAN_STEPS if step[0].startswith("^")]
NOISE_STEPS = CLEAN_STEPS[len(PREFIX_STEPS) : -4]
SPACES, CITY, PROVINCE, LAST_SPACES = CLEAN_STEPS[-4:]


def with_clean(df: DataFrame, text: str, out: str = "cleaned") -> DataFrame:
    """Adds the cleaned text. Each group of steps runs only where it can change something.

    No prefix step can apply to a text that none of their patterns matches; the
    noise steps need something else than letters and spaces; the place steps
    need a province or CA at the end.
    """
    any_prefix = "|".join(f"(?:{pattern})" for pattern, _ in PREFIX_STEPS)
    folded, stem, plain, spaced, placed = (f"_{out}_{n}" for n in range(5))
    ends = [*PROVINCES.strip("()").split("|"), "CA"]
    kept = [c for c in df.columns if c != out]
    steps = (
        df.withColumn(folded, fold_case(F.col(text)))
        .withColumn(
            stem,
            F.when(
                F.col(folded).rlike(any_prefix), replace_steps(F.col(folded), PREFIX_STEPS)
            ).otherwise(F.col(folded)),
        )
        .withColumn(
            plain,
            F.when(F.col(stem).rlike(r"[^\p{L} ]"), replace_steps(F.col(stem), NOISE_STEPS)).otherwise(F.col(stem)),
        )
        .withColumn(
            spaced,
            F.when(F.col(plain).contains("  "), replace_steps(F.col(plain), [SPACES])).otherwise(F.col(plain)),
        )
        .withColumn(
            placed,
            F.when(
                F.substring(F.rtrim(F.col(spaced)), -2, 2).isin(*ends),
                replace_steps(F.col(spaced), [CITY, PROVINCE, LAST_SPACES]),
            ).otherwise(F.col(spaced)),
        )
    )
    return settled(steps, kept, **{out: F.coalesce(marker(F.col(folded)), strip(F.col(placed)))})


def blank_to_null(text: Column) -> Column:
    trimmed = strip(text)
    return F.when(trimmed != "", trimmed)
