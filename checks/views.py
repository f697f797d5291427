"""Bank-style inputs derived from the given tables, in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.fixed import CATEGORIES
from spendlens.functions.cleaning import clean_text
from spendlens.functions.routing import needs_review
from spendlens.operators.kb_build import first_entries, place_entries, seed_entries
from spendlens.plans.classify import quick_stages
from spendlens.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(column: str) -> Column:
    return F.col(column).cast("string")


def txn(spark: SparkSession, sf: str) -> DataFrame:
    """Bank-style descriptions, one per line item."""
    lineitem = spread(
        table(spark, sf, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate"
        )
    )
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    name, upper = F.col("p_name"), F.upper("p_name")
    supplier = text_of("l_suppkey")
    forms = [
        F.concat(F.lit("POS PURCHASE - "), F.lpad(supplier, 4, "0"), F.lit(" "), upper, F.lit(" OTTAWA ON")),
        F.concat(F.lit("Visa Debit purchase - "), (F.col("l_suppkey") + 1000).cast("string"), F.lit(" "), name),
        F.concat(upper, F.lit(" #"), text_of("l_partkey"), F.lit(" KANATA ON")),
        F.concat(F.lit("SQ *"), upper, F.lit(" NEPEAN ON")),
        F.concat(F.lit("INTERAC E-TRANSFER TO "), upper),
        F.concat(F.lit("Payroll Deposit "), name),
        F.concat(F.lit("REFUND - "), upper, F.lit(" TORONTO ON")),
        F.concat(upper, F.lit(" PHARMACY")),
        F.concat(upper, F.lit(" GAS W"), supplier),
        F.concat(F.lit("TST-"), upper, F.lit(" HALIFAX NS CA")),
        F.lit("MORTGAGE PAYMENT"),
    ]
    raw = None
    for i, form in enumerate(forms):
        hit = F.when if raw is None else raw.when
        raw = hit(F.col("l_orderkey") % 12 == i, form)
    raw = raw.otherwise(F.concat(upper, F.lit(" WEB SERVICES")))
    joined = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("txn_key"),
        raw.alias("raw"),
        F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_returnflag") == "A", "mastercard").otherwise("chequing").alias("account_type"),
        F.col("l_shipdate").alias("posted_at"),
        "p_type",
    )


LABELS = {
    "PROMO": "Retail > Food and Beverage Retail > Grocery Store",
    "ECONOMY": "Retail > Pharmacy|Retail > Cosmetics Store",
    "STANDARD": "Travel and Transportation > Gas Station",
    "SMALL": "Automotive Service > Tire Shop",
    "MEDIUM": "Arts and Entertainment > Museum",
}


def place(spark: SparkSession, sf: str) -> DataFrame:
    """Points of interest, one per part; labels as an array."""
    labels = F.lit("")
    for kind, value in LABELS.items():
        labels = F.when(F.col("p_type") == kind, value).otherwise(labels)
    size = F.col("p_size")
    part = spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_type"))
    return part.select(
        F.col("p_partkey").alias("position"),
        F.col("p_name").alias("name"),
        F.when(size % 5 == 0, "US").otherwise("CA").alias("country"),
        F.when(size % 4 != 0, F.concat(F.lit("City"), size.cast("string"))).alias("locality"),
        F.when(size % 3 == 0, "ON").otherwise("QC").alias("region"),
        F.filter(F.split(labels, "[|]"), lambda x: x != "").alias("labels"),
    )


def canada(spark: SparkSession, sf: str) -> DataFrame:
    return place(spark, sf).where("country = 'CA'")


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Seed-like rows from suppliers: names, aliases and a fixed description."""
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("position"),
        F.concat(F.lit("Supplier House "), F.translate(F.substring("s_name", -2, 2), "0123456789", "ABCDEFGHIJ")).alias(
            "canonical_name"
        ),
        F.array(F.col("s_name"), F.concat(F.lit("TST-House "), text_of("s_nationkey")), F.lit("")).alias("aliases"),
        F.array(F.lit("SQ *supplier house")).alias("stripped_aliases"),
        F.when(F.col("s_nationkey") % 2 == 0, "Shopping & Retail").alias("mapped_category"),
        F.lit(0.9).alias("mapping_confidence"),
        F.lit(" wholesale supplier ").alias("metadata_text"),
    )


def kb_entries(spark: SparkSession, sf: str) -> DataFrame:
    return first_entries(seed_entries(seeds(spark, sf)), place_entries(canada(spark, sf)))


TRUE_LABELS = {
    "PROMO": "Food & Dining",
    "ECONOMY": "Healthcare & Medical",
    "STANDARD": "Transportation",
    "SMALL": "Transportation",
    "MEDIUM": "Entertainment & Recreation",
}


def true_label() -> Column:
    label = F.lit("Financial Services")
    for kind, value in TRUE_LABELS.items():
        label = F.when(F.col("p_type") == kind, value).otherwise(label)
    return F.when(F.col("raw").contains("MORTGAGE"), F.lit(None)).otherwise(label)


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions with a prediction, its source and confidence, and a true label.

    Rows no rule answers get a stand-in model answer computed from the amount.
    """
    rows = quick_stages(txn(spark, sf), "raw")
    cents = F.round(F.col("amount") * 100).cast("long")
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    confidence = F.round(F.coalesce("confidence", 0.5 + (cents % 50) / 100.0), 2)
    out = rows.select(
        "txn_key",
        "raw",
        "cleaned",
        "amount",
        "account_type",
        "posted_at",
        "p_type",
        F.coalesce("category", F.get(names, (cents % 10).cast("int"))).alias("category"),
        confidence.alias("confidence"),
        F.coalesce("source", F.lit("sgd")).alias("source"),
        true_label().alias("label"),
    )
    trusted = F.col("source") != "sgd"
    return out.withColumn("flagged_for_review", ~trusted & needs_review(F.col("confidence")))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all documents."""
    return spread(table(spark, sf, "documents").select("doc_id", "lang", "text")).select(
        "doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


def statement_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Statement pages as lines: an order is a page, a line item a few lines."""
    rows = txn(spark, sf).withColumn("page", F.floor(F.col("txn_key") / 10))
    day = F.concat(F.dayofmonth("posted_at").cast("string"), F.lit(" Jan"))
    money = F.concat(F.lit("$"), F.round("amount").cast("long").cast("string"), F.lit(".00"))
    half = F.expr("substring(raw, 1, 12)")
    rest = F.expr("substring(raw, 13)")
    parts = F.array(day, half, rest, money, F.lit("\tRoyal Bank of Canada\u00a0\r"))
    body = rows.select(
        "page",
        F.concat_ws("|", F.lit("2"), F.lpad(text_of("txn_key"), 12, "0"), "raw", F.format_string("%015.2f", "amount")).alias("item"),
        F.posexplode(parts).alias("part", "line"),
    )
    pages = rows.select("page").distinct()
    head = pages.select(
        "page", F.lit("1").alias("item"), F.posexplode(
            F.array(F.lit("Your account number"), F.lit("Before the start"), F.lit("Details of your account activity"), F.lit("Date\r"))
        ).alias("part", "line")
    )
    tail = pages.select(
        "page", F.lit("3").alias("item"), F.posexplode(
            F.array(F.lit("last open line"), F.lit("Closing Balance"), F.lit("Behind the end"))
        ).alias("part", "line")
    )
    return head.unionByName(body).unionByName(tail)


def cleaned_column(column: str) -> Column:
    return clean_text(F.col(column))
