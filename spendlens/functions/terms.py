"""Search terms of a text: words, word pairs and character grams."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlens.functions.rows import let

QUERY_TOKENS = 8


def accent_table() -> tuple[str, str]:
    """Latin letters with a mark and their base letters, by Unicode decomposition."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        letter = chr(code).lower()
        base = unicodedata.normalize("NFD", letter)[0]
        if base.isascii() and base.isalpha() and letter != base and letter not in source and len(letter) == 1:
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


def fold_accents(text: Column) -> Column:
    source, target = accent_table()
    return F.translate(F.lower(text), source, target)


def words(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def words_and_pairs(text: Column) -> Column:
    def both(tokens: Column) -> Column:
        pairs = F.when(
            F.size(tokens) > 1,
            F.zip_with(
                F.slice(tokens, F.lit(1), F.size(tokens) - 1),
                F.slice(tokens, F.lit(2), F.size(tokens) - 1),
                lambda a, b: F.concat(a, F.lit(" "), b),
            ),
        ).otherwise(F.array().cast("array<string>"))
        return F.concat(tokens, pairs)

    return let(words(text), both)


def words_and_pairs_size(text: Column) -> Column:
    """How many there are of both, without cutting the pairs."""
    n = F.size(words(text))
    return n + F.greatest(n - 1, F.lit(0))


def counted(terms: Column) -> Column:
    """Array of (term, tf) of an array of terms, in the order of the terms; null where there are none."""

    def runs(found: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (F.get(found, i) != F.get(found, i - 1))
        )
        lengths = let(starts, lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(found, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(found)) - i).cast("long").alias("tf")
        )))
        return F.when(F.size(found) > 0, lengths)

    return let(F.sort_array(terms), runs)


def index_words(text: Column) -> Column:
    """Accent-free lower-case runs of letters and digits, as full-text search cuts them."""
    return F.regexp_extract_all(fold_accents(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_words(query: Column) -> Column:
    """Up to eight runs of A-Z and 0-9 of two or more characters, lower-cased."""
    found = F.regexp_extract_all(query, F.lit(r"[A-Z0-9]+"), F.lit(0))
    long = F.filter(found, lambda t: F.length(t) >= 2)
    return F.transform(F.slice(long, 1, QUERY_TOKENS), F.lower)


def role_words(brand: Column, descriptor: Column) -> Column:
    """Brand then descriptor words without punctuation, up to eight, lower-cased."""
    stripped = F.transform(
        F.concat(brand, descriptor), lambda t: F.regexp_replace(F.upper(t), "[^A-Z0-9]", "")
    )
    long = F.filter(stripped, lambda t: F.length(t) >= 2)
    return F.transform(F.slice(long, 1, QUERY_TOKENS), F.lower)


def char_grams(text: Column, low: int, high: int) -> Column:
    """Character n-grams inside word bounds, each word padded with one space.

    A padded word shorter than n yields itself once.
    """
    padded = F.transform(
        F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""),
        lambda w: F.concat(F.lit(" "), w, F.lit(" ")),
    )

    def grams(word: Column, n: int) -> Column:
        last = F.length(word) - n
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(word, i + 1, F.lit(n)))
        short = F.array(word) if n == low else F.array().cast("array<string>")
        return F.when(last > 0, cut).when(last == 0, F.array(word)).otherwise(short)

    return F.flatten(
        F.transform(padded, lambda w: F.concat(*[grams(w, n) for n in range(low, high + 1)]))
    )
