"""Weighted-term search: TF-IDF cosine and BM25 top-k by joins on terms.

Results are exact. Common terms are not dropped and not joined blindly:

1. The heaviest postings of each query term give a score that the k-th best
   document of the query is sure to reach.
2. Terms that together cannot lift a document to that score generate no
   candidates. The others read only posting buckets (by weight) that can.
3. Surviving candidates get the remaining terms by a join on (document, term).

Buckets of a very common term are salted, so no task holds a whole term. Few
query terms are sent to all postings instead: these are dealt by document
once, and every score is whole where it is made.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.rows import exploded
from spendlens.functions.terms import counted, index_words, words_and_pairs
from spendlens.operators.ranking import top_n
from spendlens.session import cut_lineage

# BM25 parameters and the floor of its term weight.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6

RANK_DIGITS = 12  # sums that agree in these are ties, so ranks do not depend on the order of summing
SCORE_DIGITS = 6  # of the score that is returned
BUCKET_ROWS = 50_000
FEW_TERMS = 50_000  # rows of query terms up to which a search sends them to all postings


def term_counts(docs: DataFrame, doc: str, terms: Column) -> DataFrame:
    """(doc, term, tf) over the whole text of each document."""
    return (
        exploded(docs, [doc], terms, "term").groupBy(doc, "term").agg(F.count("*").alias("tf"))
    )


def document_terms(rows: DataFrame, doc: str, terms: Column, *keep: str) -> DataFrame:
    """(doc, *keep, term, tf) as grouping the terms by all of these gives, but counted inside the row of a document.

    Only documents whose id comes more than once are grouped.
    """
    keys = [doc, *keep]
    again = rows.groupBy(doc).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(doc).alias("_again"))
    again = cut_lineage(again)

    def alone(part: DataFrame) -> DataFrame:
        return exploded(part, keys, counted(terms), "_run").select(*keys, "_run.term", "_run.tf")

    if again.isEmpty():
        return alone(rows)
    same = F.col(doc).eqNullSafe(F.col("_again"))
    repeated = exploded(rows.join(again, same, "left_semi"), keys, terms, "term")
    grouped = repeated.groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    return alone(rows.join(again, same, "left_anti")).unionByName(grouped)


def tfidf_weight(documents: Column, hits: Column) -> Column:
    """Smoothed idf."""
    return F.log((1.0 + documents) / (1.0 + hits)) + 1.0


def document_norms(counts: DataFrame, doc: str, documents: Column) -> DataFrame:
    """(doc, norm): length of each document's vector of tf x idf.

    The postings are dealt by term once, which tells a term's documents, and
    summed by document in the tasks.
    """
    hits = F.count("*").over(Window.partitionBy("term"))
    weighed = counts.select(doc, "tf", hits.alias("hits"))
    raw = F.col("tf") * tfidf_weight(documents, F.col("hits"))
    return weighed.groupBy(doc).agg(F.sqrt(F.sum(raw * raw)).alias("norm"))


def tfidf_terms(counts: DataFrame, documents: Column) -> DataFrame:
    """(term, idf) with smoothed idf."""
    return counts.groupBy("term").agg(tfidf_weight(documents, F.count("*")).alias("idf"))


def unit_weights(counts: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, term, weight): tf x idf scaled to unit length per key."""
    weighted = counts.join(terms, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return weighted.join(norms, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def document_count(docs: DataFrame) -> Column:
    return docs.agg(F.count("*")).scalar()


def asked_terms(rows: DataFrame, terms: Column) -> DataFrame:
    """Different terms of some queries, written out so that Spark knows their size and sends few to every task."""
    return cut_lineage(exploded(rows, [], terms, "term").distinct())


def tfidf_index(docs: DataFrame, doc: str, text: str, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (doc, term, weight) and terms (term, idf) of a corpus.

    `asked` names the terms (term) that one search needs: only their postings
    are made. Weights still come from all terms of all documents: the norms
    and the postings that are asked for are written once.
    """
    counts = document_terms(docs, doc, words_and_pairs(F.col(text)))
    total = document_count(docs)
    if asked is None:
        terms = tfidf_terms(counts, total)
        return unit_weights(counts, terms, doc), terms
    norms = cut_lineage(document_norms(counts, doc, total))
    found = cut_lineage(counts.join(asked, "term", "left_semi"))
    known = cut_lineage(tfidf_terms(found, total))
    weight = (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight")
    return found.join(known, "term").join(norms, doc).select(doc, "term", weight), known


def tfidf_query_terms(queries: DataFrame, terms: DataFrame, query: str, text: str) -> DataFrame:
    """(query, term, qweight): unit vectors over the corpus vocabulary."""
    counts = term_counts(queries, query, words_and_pairs(F.col(text)))
    return unit_weights(counts, terms, query).withColumnRenamed("weight", "qweight")


def bm25_idf(documents: Column, hits: Column) -> Column:
    return F.greatest(F.log((documents - hits + 0.5) / (hits + 0.5)), F.lit(IDF_FLOOR))


def bm25_share(tf: Column, length: Column, average: Column) -> Column:
    """What a posting gives per unit of its term's weight."""
    tf = tf.cast("double")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bm25_index(docs: DataFrame, doc: str, text: str, asked: DataFrame | None = None) -> DataFrame:
    """Postings (doc, term, weight) holding each term's whole BM25 share.

    `asked` names the terms (term) that one search needs: only their postings
    are counted, in a pass over all documents. Lengths are those of whole texts.
    """
    cut = docs.select(doc, index_words(F.col(text)).alias("tokens"))
    sized = cut.select(doc, F.size("tokens").alias("length"), "tokens")
    found = exploded(sized, [doc, "length"], "tokens", "term")
    if asked is not None:
        found = found.join(asked, "term", "left_semi")
    counts = found.groupBy(doc, "length", "term").agg(F.count("*").alias("tf"))
    if asked is not None:
        counts = cut_lineage(counts)
    total = document_count(docs)
    average = sized.agg(F.avg("length")).scalar()
    hits = counts.groupBy("term").agg(F.count("*").alias("hits"))
    idf = hits.select("term", bm25_idf(total, F.col("hits")).alias("idf"))
    share = bm25_share(F.col("tf"), F.col("length"), average)
    return counts.join(idf, "term").select(doc, "term", (F.col("idf") * share).alias("weight"))


def bm25_query_terms(queries: DataFrame, query: str, terms: Column) -> DataFrame:
    """(query, term, qweight): a repeated word counts once per repeat."""
    return (
        exploded(queries, [query], terms, "term")
        .groupBy(query, "term")
        .agg(F.count("*").cast("double").alias("qweight"))
    )


def weight_bucket(weight: Column) -> Column:
    """Halving steps of the weight, so buckets hold ever more and ever lighter postings."""
    return F.floor(-F.log2(weight)).cast("int")


def bucketed(postings: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """Postings with (bucket, salt), and one row per (term, bucket)."""
    rows = postings.withColumn("bucket", weight_bucket(F.col("weight")))
    sizes = rows.groupBy("term", "bucket").agg(
        F.max("weight").alias("top"), F.ceil(F.count("*") / F.lit(BUCKET_ROWS)).cast("int").alias("salts")
    )
    big = sizes.where(F.col("salts") > 1).select("term", "bucket", "salts")
    salted = rows.join(big, ["term", "bucket"], "left").withColumn(
        "salt", F.pmod(F.xxhash64(doc), F.coalesce("salts", F.lit(1))).cast("int")
    )
    return salted.drop("salts"), sizes


def below(score: Column) -> Column:
    """A bound that rounding to RANK_DIGITS and the order of summing cannot lift a lower score over."""
    return score * (1 - 1e-9) - F.lit(2 * 10.0**-RANK_DIGITS)


class Postings(NamedTuple):
    """What a search reads: rows (doc, term, weight, bucket, salt), sizes (term, bucket, top, salts) and the heaviest
    rows of each term."""

    rows: DataFrame
    sizes: DataFrame
    heavy: Callable[[int], DataFrame]


def in_buckets(postings: DataFrame, doc: str) -> Postings:
    """Postings (doc, term, weight) written out and cut into buckets for one search."""
    postings = cut_lineage(postings.select(doc, "term", "weight"))
    rows, sizes = bucketed(postings, doc)
    return Postings(
        rows, sizes, lambda k: top_n(postings, ["term"], [F.desc("weight"), F.asc(doc)], k).drop("rank")
    )


def sure_scores(query_terms: DataFrame, heavy: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """(query, floor): a score the k-th best document reaches, by the heaviest postings per term."""
    partial = (
        query_terms.join(heavy, "term")
        .groupBy(query, doc)
        .agg(F.sum(F.col("qweight") * F.col("weight")).alias("score"))
    )
    ranked = top_n(partial, [query], [F.desc("score"), F.asc(doc)], k)
    return ranked.where(F.col("rank") == k).select(query, below(F.col("score")).alias("floor"))


def best_documents(shares: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """The k best documents of each query by the sum of their shares."""
    scored = (
        shares.groupBy(query, doc)
        .agg(F.round(F.sum("share"), RANK_DIGITS).alias("score"))
        .where(F.col("score") > 0)
    )
    best = top_n(scored, [query], [F.desc("score"), F.asc(doc)], k)
    return best.withColumn("score", F.round("score", SCORE_DIGITS))


def sparse_top_k(
    query_terms: DataFrame,
    postings: DataFrame | Postings,
    k: int,
    query: str = "query_id",
    doc: str = "doc_id",
) -> DataFrame:
    """(query, doc, score, rank): k best documents by summed qweight x weight.

    Postings are (doc, term, weight), or come in buckets from a stored index.

    Documents are ranked by the score to RANK_DIGITS digits; ties go to the
    smaller document id. All hits with a score above zero count. The returned
    score is rounded to SCORE_DIGITS.
    """
    query_terms = cut_lineage(query_terms)
    if query_terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
        dealt = (postings.rows if isinstance(postings, Postings) else postings).select(doc, "term", "weight").repartition(doc)
        shares = dealt.join(query_terms.where(F.col(query).isNotNull()), "term")
        return best_documents(shares.select(query, doc, (F.col("qweight") * F.col("weight")).alias("share")), query, doc, k)
    rows, sizes, heavy = postings if isinstance(postings, Postings) else in_buckets(postings, doc)
    tops = sizes.groupBy("term").agg(F.max("top").alias("term_top"))
    wanted = query_terms.join(tops, "term").withColumn("most", F.col("qweight") * F.col("term_top"))
    floors = sure_scores(query_terms, heavy(k), query, doc, k)
    small_first = Window.partitionBy(query).orderBy("most", "term")
    plan = (
        wanted.join(floors, query, "left")
        .withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        .withColumn("upto", F.sum("most").over(small_first.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("all_most", F.sum("most").over(Window.partitionBy(query)))
        .withColumn("idle", F.col("upto") < F.col("floor"))
    )
    plan = cut_lineage(plan)
    readable = (
        plan.where(~F.col("idle"))
        .join(sizes, "term")
        .where(F.col("qweight") * F.col("top") + F.col("all_most") - F.col("most") >= F.col("floor"))
        .select(
            query, "term", "qweight", "bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
        )
    )
    partial = (
        readable.join(rows, ["term", "bucket", "salt"])
        .groupBy(query, doc)
        .agg(F.sum(F.col("qweight") * F.col("weight")).alias("partial"))
    )
    limits = plan.groupBy(query).agg(
        F.first("floor").alias("floor"),
        F.sum(F.when(F.col("idle"), F.col("most")).otherwise(0.0)).alias("idle_most"),
    )
    alive = cut_lineage(
        partial.join(limits, query)
        .where(F.col("partial") + F.col("idle_most") >= F.col("floor"))
        .select(query, doc, "partial")
    )
    idle = plan.where("idle").select(query, "term", "qweight")
    rest = (
        alive.select(query, doc)
        .join(idle, query)
        .join(rows.select(doc, "term", "weight"), [doc, "term"])
        .select(query, doc, (F.col("qweight") * F.col("weight")).alias("share"))
    )
    shares = alive.select(query, doc, F.col("partial").alias("share")).unionByName(rest)
    return best_documents(shares, query, doc, k)
