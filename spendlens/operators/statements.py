"""Statement pages to transaction descriptions, inside the row: no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens import fixed
from spendlens.functions.rows import let, posexploded
from spendlens.functions.white import strip


def page_lines(text: Column) -> Column:
    """Trimmed lines of a page."""
    return F.transform(F.split(strip(F.coalesce(text, F.lit(""))), "\n"), strip)


def pages_from_lines(lines: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Page texts from a table of lines; a page is one row, so its lines meet once."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return lines.groupBy(*keys).agg(
        F.concat_ws("\n", F.transform(ordered, lambda s: s[text])).alias("text")
    )


def blank(line: Column) -> Column:
    return (line == "") | (line == ".")


def starts_with_any(line: Column, starts: list[str]) -> Column:
    hit = F.lit(False)
    for start in starts:
        hit = hit | line.startswith(start)
    return hit


def contains_any(line: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | line.contains(word)
    return hit


def any_pattern(patterns: list[str]) -> str:
    """One pattern that finds what any of them finds.

    Those tied to the start of the text share one anchor, so a text is tried at
    its first place and not at every other.
    """
    tied, free = [], []
    for pattern in patterns:
        flags, anchor, rest = re.match(r"(?:\(\?([a-z]+)\))?(\^?)(.*)", pattern, re.DOTALL).groups()
        tied_down = anchor and "|" not in re.sub(r"\([^()]*\)", "", rest)
        (tied if tied_down else free).append(f"(?{flags or ''}:{rest if tied_down else anchor + rest})")
    return "|".join([*([f"^(?:{'|'.join(tied)})"] if tied else []), *free])


def boilerplate(line: Column, extra: list[str] | None = None) -> Column:
    hit = line.isin(*fixed.CARD_HEADERS, *fixed.ACCOUNT_HEADERS) | line.rlike(any_pattern(fixed.BOILERPLATE))
    for pattern in extra or []:
        hit = hit | line.rlike(pattern)
    return hit


def line_kind(line: Column, extra_boilerplate: list[str] | None = None) -> Column:
    """Kind of one trimmed line, first hit wins."""
    return (
        F.when(blank(line), "blank")
        .when(
            line.contains(fixed.ACCOUNT_STOP_INSIDE)
            | line.startswith(fixed.ACCOUNT_STOP_START)
            | starts_with_any(line, fixed.CARD_STOPS),
            "stop",
        )
        .when(line.isin(*fixed.CARD_HEADERS, *fixed.ACCOUNT_HEADERS), "header")
        .when(line.rlike(fixed.CARD_DATE) | line.rlike(fixed.ACCOUNT_DATE), "date")
        .when(line.rlike(fixed.REFERENCE_NUMBER), "reference")
        .when(line.rlike(fixed.AMOUNT_LINE), "amount")
        .when(line.rlike(fixed.FOREX_LINE), "forex")
        .when(boilerplate(line, extra_boilerplate), "boilerplate")
        .otherwise("text")
    )


def after_first(lines: Column, test) -> Column:
    """Lines behind the first that passes the test; none when no line does."""
    none = F.array().cast("array<string>")

    def behind(known: Column) -> Column:
        place = F.array_position(F.transform(known, test), True)
        return let(place, lambda at: F.when(at > 0, F.slice(known, (at + 1).cast("int"), F.size(known))).otherwise(none))

    return let(lines, behind)


def before_first(lines: Column, test) -> Column:
    def before(known: Column) -> Column:
        place = F.array_position(F.transform(known, test), True)
        return let(place, lambda at: F.when(at > 0, F.slice(known, F.lit(1), (at - 1).cast("int"))).otherwise(known))

    return let(lines, before)


def account_descriptions(text: Column, extra_boilerplate: list[str] | None = None) -> Column:
    """Descriptions of a chequing page.

    Between the start and the stop marker, neighbouring text lines join to one
    description; a date, an amount or the end of the section closes it.
    """
    section = before_first(
        after_first(page_lines(text), lambda x: contains_any(x, fixed.ACCOUNT_STARTS)),
        lambda x: x.contains(fixed.ACCOUNT_STOP_INSIDE) | x.startswith(fixed.ACCOUNT_STOP_START),
    )
    kept = F.filter(section, lambda x: ~(blank(x) | boilerplate(x, extra_boilerplate)))
    nothing = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("done"), nothing.alias("open"))

    def close(acc: Column) -> Column:
        return F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    def step(acc: Column, line: Column) -> Column:
        ends = line.rlike(fixed.ACCOUNT_DATE) | line.rlike(fixed.AMOUNT_LINE)
        return F.struct(
            F.when(ends, close(acc)).otherwise(acc["done"]).alias("done"),
            F.when(ends, nothing).otherwise(F.concat_ws(" ", acc["open"], line)).alias("open"),
        )

    return F.aggregate(kept, start, step, close)


def card_descriptions(text: Column) -> Column:
    """Descriptions of a card page: one per kept line behind the activity header."""
    behind = after_first(page_lines(text), lambda x: x.contains(fixed.CARD_START))
    section = before_first(behind, lambda x: starts_with_any(x, fixed.CARD_STOPS))
    shapes = [fixed.CARD_DATE, fixed.REFERENCE_NUMBER, fixed.AMOUNT_LINE, fixed.FOREX_LINE, fixed.CARD_REWARD_LINE]

    def noise(line: Column) -> Column:
        hit = blank(line)
        for shape in shapes:
            hit = hit | line.rlike(shape)
        return hit

    # Column titles right behind the header go; the same words further down stay.
    titles = ["AMOUNT ($)", "DATE", ""]
    none = F.array().cast("array<string>")

    def from_first_real(lines: Column) -> Column:
        place = F.array_position(F.transform(lines, lambda x: ~x.isin(*titles)), True)
        return let(place, lambda at: F.when(at > 0, F.slice(lines, at.cast("int"), F.size(lines))).otherwise(none))

    body = let(section, from_first_real)
    kept = F.filter(body, lambda x: ~noise(x))
    stripped = F.transform(kept, lambda x: strip(F.regexp_replace(x, fixed.CARD_LEADING_DATE, "")))
    return F.filter(stripped, lambda x: x != "")


def descriptions(pages: DataFrame, text: str, account_type: str, extra_boilerplate: list[str] | None = None) -> DataFrame:
    """One row per description with its position on the page."""
    card = F.when(F.col(account_type) == "mastercard", card_descriptions(F.col(text))).otherwise(
        account_descriptions(F.col(text), extra_boilerplate)
    )
    keep = [c for c in pages.columns if c != text]
    return posexploded(pages, keep, card, "pos", "description")


def has_activity(text: Column) -> Column:
    """Does a page hold any of the activity words?"""
    return F.lower(text).rlike("|".join(fixed.PAGE_WORDS))


def statement_summary(transactions: DataFrame) -> DataFrame:
    """Totals by account type and by debit and credit."""
    return transactions.groupBy("account_type").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("type") == "debit").alias("debits"),
        F.count_if(F.col("type") == "credit").alias("credits"),
        F.sum("amount").alias("amount"),
    )
