"""Merchant search: exact alias, brand alias, then fused lexical and dense search."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.cleaning import clean_text, with_clean
from spendlens.functions.rows import settled
from spendlens.functions.terms import query_words, role_words
from spendlens.functions.tokens import analyze
from spendlens.operators.dense import nearest
from spendlens.operators.embedding import Encoder, stored_vectors, text_vectors
from spendlens.operators.exact import alias_index, brand_positions, lookup
from spendlens.operators.fusion import PairScorer, choose, cut, fuse, rerank, seed_list
from spendlens.operators.lexical import (
    bm25_index,
    bm25_query_terms,
    sparse_top_k,
    tfidf_index,
    tfidf_query_terms,
)
from spendlens.operators.stored_index import StoredIndex, search_terms, search_texts
from spendlens.options import DEFAULTS, Options
from spendlens.session import cut_lineage


class Knowledge(NamedTuple):
    """Tables of a knowledge base. Search lists whose table is None stay empty. `postings` may be a stored index.

    `kept` is a folder that keeps the vectors of query texts, so that a text is encoded once over all searches.
    """

    entries: DataFrame
    aliases: DataFrame
    postings: DataFrame | StoredIndex | None = None
    terms: DataFrame | None = None
    vectors: DataFrame | None = None
    kept: str | None = None


MATCH_COLUMNS = [
    "entry_id", "matched_alias", "similarity", "strategy", "dense_score", "lexical_score",
    "fused_score", "rerank_score",
]


def index_knowledge(
    entries: DataFrame,
    aliases: DataFrame,
    lexical: str | None = "bm25",
    dense: bool = False,
    encoder: Encoder | None = None,
) -> Knowledge:
    """Search tables of entries. `lexical`: "bm25", "tfidf" or None."""
    postings = terms = vectors = None
    if lexical == "bm25":
        postings = bm25_index(entries, "entry_id", "document")
    elif lexical == "tfidf":
        postings, terms = tfidf_index(entries, "entry_id", "document")
    if dense:
        vectors = text_vectors(entries.select("entry_id", "document"), "document", encoder).select(
            "entry_id", "vector"
        )
    return Knowledge(entries, aliases, postings, terms, vectors)


def decompose(texts: DataFrame, aliases: DataFrame | None, text: str = "text") -> DataFrame:
    """Texts with the struct of their token roles, brands joined from the aliases."""
    if aliases is None:
        return analyze(texts, text)
    brands = brand_positions(texts, aliases, text)
    return analyze(texts.join(brands, text, "left"), text, brands="brand_positions").drop("brand_positions")


def lexical_candidates(
    queries: DataFrame, kb: Knowledge, use_tokens: bool, options: Options = DEFAULTS
) -> DataFrame | None:
    """Ranked lexical list. Token roles only steer the BM25 index."""
    if kb.postings is None:
        return None
    stored = isinstance(kb.postings, StoredIndex)
    if stored and kb.postings.kind == "tfidf":
        return search_texts(kb.postings, queries, options.lexical_candidates, "query_id", "query")
    if kb.terms is not None:
        wanted = tfidf_query_terms(queries, kb.terms, "query_id", "query")
        score = F.col("score")
    else:
        words = query_words(F.col("query"))
        if use_tokens:
            by_role = role_words(F.col("decomposed.brand_tokens"), F.col("decomposed.descriptor_tokens"))
            words = F.when(F.size(by_role) > 0, by_role).otherwise(words)
        asked = queries.select("query_id", words.alias("words"))
        wanted = bm25_query_terms(asked, "query_id", F.col("words"))
        score = 1.0 / F.col("rank")
    if stored:
        ranked = search_terms(kb.postings, wanted, options.lexical_candidates)
    else:
        ranked = sparse_top_k(wanted, kb.postings, options.lexical_candidates, "query_id", "entry_id")
    return ranked.withColumn("score", score)


def dense_candidates(
    queries: DataFrame, kb: Knowledge, encoder: Encoder | None, options: Options = DEFAULTS
) -> DataFrame | None:
    if kb.vectors is None:
        return None
    text = F.when(F.length("brand_query") >= options.min_query_chars, F.col("brand_query")).otherwise(F.col("query"))
    asked = queries.select("query_id", text.alias("asked"))
    vectors = stored_vectors(asked, "asked", kb.kept, encoder) if kb.kept else text_vectors(asked, "asked", encoder)
    # Written out once: the join reads the queries twice, and an encoder need not give the same bits again.
    vectors = cut_lineage(vectors.select("query_id", "vector"))
    found = nearest(vectors, kb.vectors, options.dense_candidates)
    return found.withColumnRenamed("similarity", "score")


def exact_match(rows: DataFrame, ids: str, alias: str) -> DataFrame:
    one = F.lit(1.0)
    return rows.select(
        "query_id",
        F.col(ids)[0].alias("entry_id"),
        F.col(alias).alias("matched_alias"),
        one.alias("similarity"),
        F.lit("exact").alias("strategy"),
        one.alias("dense_score"),
        one.alias("lexical_score"),
        one.alias("fused_score"),
        one.alias("rerank_score"),
    )


def search(
    texts: DataFrame,
    kb: Knowledge,
    use_tokens: bool = True,
    scorer: PairScorer | str | None = None,
    encoder: Encoder | None = None,
    options: Options = DEFAULTS,
) -> DataFrame:
    """One row per distinct text: its token roles and its match, if any.

    Only texts without a decisive alias reach the similarity joins.
    """
    asked = texts.select("text").distinct()
    asked = decompose(asked, kb.aliases if use_tokens else None, "text")
    keyed = with_clean(asked.select("text", "decomposed", F.md5("text").alias("query_id")), "text", "query")
    if use_tokens:
        keyed = keyed.withColumn("brand_query", F.col("decomposed.brand_query"))
    else:
        keyed = keyed.withColumn("brand_query", F.col("query"))
    long_enough = F.length("query") >= options.min_query_chars
    index = alias_index(kb.aliases, options)
    # Both residues feed several joins: written out once, they also keep the plans short.
    keyed = cut_lineage(keyed)
    first = cut_lineage(lookup(keyed.where(long_enough), index, "query", "exact_ids"))
    decisive = F.size("exact_ids") == 1

    brand = clean_text(F.col("brand_query"))
    differs = (F.col("brand_query") != "") & (F.col("brand_query") != F.col("query"))
    open_rows = first.where(~decisive)
    residue = settled(
        open_rows,
        open_rows.columns,
        brand=F.when(differs & (F.length(brand) >= options.min_query_chars), brand),
    )
    with_brand = lookup(residue.where(F.col("brand").isNotNull()), index, "brand", "brand_ids")
    without = residue.where(F.col("brand").isNull()).withColumn(
        "brand_ids", F.array().cast("array<string>")
    )
    second = cut_lineage(with_brand.unionByName(without))
    brand_decisive = F.size("brand_ids") == 1

    open_queries = second.where(~brand_decisive).withColumn(
        "seed_ids", F.array_distinct(F.concat("exact_ids", "brand_ids"))
    )
    fused = fuse(
        lexical_candidates(open_queries, kb, use_tokens, options),
        dense_candidates(open_queries, kb, encoder, options),
        seed_list(open_queries),
        options,
    )
    documents = kb.entries.select("entry_id", "canonical_name", "document")
    candidates = (
        cut(fused, options)
        .join(open_queries.select("query_id", "query"), "query_id")
        .join(documents, "entry_id")
    )
    found = choose(rerank(candidates, "query", "document", scorer), "query", options)
    matches = (
        exact_match(first.where(decisive), "exact_ids", "query")
        .unionByName(exact_match(second.where(brand_decisive), "brand_ids", "brand"))
        .unionByName(found)
    )
    return (
        keyed.select("query_id", "text", "query", "decomposed")
        .join(matches, "query_id", "left")
        .select("text", "query", "decomposed", *MATCH_COLUMNS)
    )
