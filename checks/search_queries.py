"""Exact, lexical, dense and fused search, and the cascade."""

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import sql as q
from checks.kb_queries import KB_CTES, PLACE_ALIAS
from checks.registry import query
from checks.text_queries import CLEAN_TEXTS, DECOMPOSED, branded_roles, distinct_texts, recursive, role_ctes
from checks.views import kb_entries, table, txn
from spendlens.fixed import CATEGORIES, OVERRIDE_HINTS
from spendlens.functions.routing import descriptor_override, direct_gate, enrich_gate
from spendlens.functions.terms import index_words, query_words, role_words, words_and_pairs
from spendlens.functions.tokens import analyze
from spendlens.operators.dense import nearest
from spendlens.operators.embedding import hashed_vectors, stored_vectors
from spendlens.operators.exact import alias_index, lookup
from spendlens.operators.fusion import choose, cut, fuse, rerank
from spendlens.operators.kb_build import alias_table
from spendlens.operators.labelling import attach_labels
from spendlens.operators.lexical import (
    B,
    IDF_FLOOR,
    K1,
    asked_terms,
    bm25_index,
    bm25_query_terms,
    sparse_top_k,
    tfidf_index,
    tfidf_query_terms,
)
from spendlens.operators.models import cosine
from spendlens.operators.stored_index import append_index, build_index, open_index, search_terms, search_texts
from spendlens.options import Options
from spendlens.plans.classify import Stage, classify
from spendlens.plans.search import Knowledge, index_knowledge, search
from spendlens.session import cut_lineage, shared_folder

LOOKUP = """
ids AS (SELECT alias, string_agg(entry_id, '|' ORDER BY priority DESC, entry_id) AS entry_ids, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY alias ORDER BY priority DESC, entry_id) AS r FROM aliases) WHERE r <= 8 GROUP BY alias)"""


@query("j1_exact_alias", q.with_(*KB_CTES, PLACE_ALIAS, q.TXN, q.CLEANED, CLEAN_TEXTS, LOOKUP) + """
SELECT text, coalesce(entry_ids, '') AS entry_ids, coalesce(n, 0) = 1 AS decisive FROM texts t LEFT JOIN ids ON t.text = ids.alias""")
def j1_exact_alias(spark, sf):
    index = alias_index(alias_table(stored_entries(spark, sf)))
    found = lookup(distinct_texts(spark, sf), index, "text", "ids")
    return found.select("text", F.concat_ws("|", "ids").alias("entry_ids"), (F.size("ids") == 1).alias("decisive"))


@query("j2_brand_exact", q.with_(*KB_CTES, PLACE_ALIAS, q.TXN, q.CLEANED, CLEAN_TEXTS, role_ctes("texts"), DECOMPOSED, LOOKUP, f"""
brands AS (SELECT text, brand_query, {q.clean("brand_query")} AS brand FROM dec
  WHERE brand_query <> text AND length({q.clean("brand_query")}) >= 3 AND text NOT IN (SELECT alias FROM ids WHERE n = 1))""") + """
SELECT text, brand, coalesce(entry_ids, '') AS entry_ids FROM brands LEFT JOIN ids ON brands.brand = ids.alias""")
def j2_brand_exact(spark, sf):
    from spendlens.functions.cleaning import with_clean

    index = alias_index(alias_table(stored_entries(spark, sf)))
    first = lookup(distinct_texts(spark, sf), index, "text", "ids").where(F.size("ids") != 1)
    named = analyze(first, "text", "a").select("text", F.col("a.brand_query").alias("brand_query"))
    brands = with_clean(named.where(F.col("brand_query") != F.col("text")), "brand_query", "brand")
    found = lookup(brands.where(F.length("brand") >= 3), index, "brand", "brand_ids")
    return found.select("text", "brand", F.concat_ws("|", "brand_ids").alias("entry_ids"))


@query("j3_long_enough", q.with_(q.TXN, q.CLEANED) + """
SELECT cleaned AS text FROM raw_clean WHERE length(cleaned) >= 3 GROUP BY 1""")
def j3_long_enough(spark, sf):
    return distinct_texts(spark, sf).where(F.length("text") >= 3)


GRAMS = r"""
cut_{n} AS (SELECT {k} AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{{{2,}}}}') AS w FROM {n}),
terms_{n} AS (SELECT id, unnest(w || list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM cut_{n}),
tf_{n} AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM terms_{n} GROUP BY ALL)"""


def grams(name: str, key: str) -> str:
    return GRAMS.replace("{{{{", "{{").replace("}}}}", "}}").format(n=name, k=key)


TFIDF = f"""
{grams("documents", "doc_id")},
{grams("benchmark", "item_id")},
idf AS MATERIALIZED (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM tf_documents GROUP BY term),
wd AS (SELECT id, term, tf * idf AS w FROM tf_documents JOIN idf USING (term)),
nd AS (SELECT id, sqrt(sum(w * w)) AS norm FROM wd GROUP BY id),
wq AS (SELECT id, term, tf * idf AS w FROM tf_benchmark JOIN idf USING (term)),
nq AS (SELECT id, sqrt(sum(w * w)) AS norm FROM wq GROUP BY id),
scores AS (SELECT wq.id AS item_id, wd.id AS doc_id, round(sum(wq.w / nq.norm * wd.w / nd.norm), 12) AS score
  FROM wq JOIN wd USING (term) JOIN nq ON nq.id = wq.id JOIN nd ON nd.id = wd.id GROUP BY ALL)"""

RANKED = """
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 5"""


@query("j4_tfidf_top5", q.with_(TFIDF) + RANKED)
def j4_tfidf_top5(spark, sf):
    queries = table(spark, sf, "benchmark")
    asked = asked_terms(queries, words_and_pairs(F.col("text")))
    postings, terms = tfidf_index(docs(spark, sf), "doc_id", "text", asked)
    wanted = tfidf_query_terms(queries, terms, "item_id", "text")
    return top5(sparse_top_k(wanted, postings, 5, "item_id", "doc_id"))


def docs(spark, sf):
    from spendlens.session import spread

    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def top5(found):
    return found.select("item_id", "doc_id", "score", "rank")


def bm25(corpus: str, key: str, text: str, out: str) -> str:
    return rf"""
w_{out} AS (SELECT {key} AS id, regexp_extract_all({q.fold_accents(text)}, '[\p{{L}}\p{{N}}]+') AS w FROM {corpus}),
len_{out} AS (SELECT id, len(w) AS length FROM w_{out}),
tf_{out} AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM w_{out}) GROUP BY ALL),
post_{out} AS MATERIALIZED (SELECT t.id, t.term,
  greatest(ln(((SELECT count(*) FROM {corpus}) - h.hits + 0.5) / (h.hits + 0.5)), {IDF_FLOOR}) * tf * {K1 + 1} /
  (tf + {K1} * (1 - {B} + {B} * length / (SELECT avg(length) FROM len_{out}))) AS weight
  FROM tf_{out} t JOIN (SELECT term, count(*) AS hits FROM tf_{out} GROUP BY term) h USING (term) JOIN len_{out} l ON l.id = t.id)"""


BENCH_WORDS = """
bq AS (SELECT item_id, unnest(list_transform(list_filter(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[A-Z0-9]+'), lambda x: length(x) >= 2)[1:8], lambda x: lower(x))) AS term FROM benchmark),
scores AS (SELECT item_id, id AS doc_id, round(sum(weight), 12) AS score FROM bq JOIN post_d USING (term) GROUP BY ALL)"""


@query("j5_bm25_top5", q.with_(bm25("documents", "doc_id", "text", "d"), BENCH_WORDS) + RANKED)
def j5_bm25_top5(spark, sf):
    wanted = cut_lineage(bm25_query_terms(table(spark, sf, "benchmark"), "item_id", query_words(F.upper("text"))))
    postings = bm25_index(docs(spark, sf), "doc_id", "text", asked_terms(wanted, F.array("term")))
    return top5(sparse_top_k(wanted, postings, 5, "item_id", "doc_id"))


# Words in so many documents that their weight is at its floor.
COMMON = """
cq AS (SELECT item_id, unnest(CASE CAST(item_id % 3 AS INT) WHEN 0 THEN ['the'] WHEN 1 THEN ['the', 'of', 'in'] ELSE ['and', 'the', 'the'] END) AS term FROM benchmark),
scores AS (SELECT item_id, id AS doc_id, round(sum(weight), 12) AS score FROM cq JOIN post_d USING (term) GROUP BY ALL)"""


@query("j5_common_terms", q.with_(bm25("documents", "doc_id", "text", "d"), COMMON) + RANKED.replace("rank <= 5", "rank <= 15"))
def j5_common_terms(spark, sf):
    third = F.col("item_id") % 3
    words = F.when(third == 0, F.array(F.lit("the"))).when(third == 1, F.array(*map(F.lit, ("the", "of", "in"))))
    words = words.otherwise(F.array(*map(F.lit, ("and", "the", "the"))))
    wanted = cut_lineage(bm25_query_terms(table(spark, sf, "benchmark"), "item_id", words))
    postings = bm25_index(docs(spark, sf), "doc_id", "text", asked_terms(wanted, F.array("term")))
    return top5(sparse_top_k(wanted, postings, 15, "item_id", "doc_id"))


def in_two_batches(spark, sf, kind):
    """A stored index of all documents: half of them first, all of them (half are known by then) appended."""
    rows, root = docs(spark, sf), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    first = build_index(rows.where("doc_id % 2 = 0"), "doc_id", "text", root, kind, bins=16)
    append_index(first, rows, "text")
    return open_index(spark, root)


@query("j4_stored_tfidf_top5", q.with_(TFIDF) + RANKED)
def j4_stored_tfidf_top5(spark, sf):
    index = in_two_batches(spark, sf, "tfidf")
    return top5(search_texts(index, table(spark, sf, "benchmark"), 5, "item_id", "text"))


@query("j5_stored_bm25_top5", q.with_(bm25("documents", "doc_id", "text", "d"), BENCH_WORDS) + RANKED)
def j5_stored_bm25_top5(spark, sf):
    wanted = bm25_query_terms(table(spark, sf, "benchmark"), "item_id", query_words(F.upper("text")))
    return top5(search_terms(in_two_batches(spark, sf, "bm25"), wanted, 5, "item_id"))


ROLE_WORDS = """
rw AS (SELECT text, list_filter(list_transform(string_split(brand_tokens || ' ' || descriptor_tokens, ' '),
  lambda x: regexp_replace(upper(x), '[^A-Z0-9]', '', 'g')), lambda x: length(x) >= 2)[1:8] AS w FROM dec),
rq AS (SELECT text, unnest(list_transform(w, lambda x: lower(x))) AS term FROM rw),
scores AS (SELECT text, id AS entry_id, round(sum(weight), 12) AS score FROM rq JOIN post_e USING (term) GROUP BY ALL)"""


@query("j6_bm25_roles", q.with_(*KB_CTES, q.TXN, q.CLEANED, CLEAN_TEXTS, role_ctes("texts"), DECOMPOSED,
       bm25("entries", "entry_id", "document", "e"), ROLE_WORDS) + """
SELECT text, entry_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, entry_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 15""")
def j6_bm25_roles(spark, sf):
    roles = analyze(distinct_texts(spark, sf), "text", "a")
    wanted = bm25_query_terms(roles, "text", role_words(F.col("a.brand_tokens"), F.col("a.descriptor_tokens")))
    wanted = cut_lineage(wanted)
    postings = bm25_index(stored_entries(spark, sf), "entry_id", "document")
    found = sparse_top_k(wanted, postings, 15, "text", "entry_id")
    return found.select("text", "entry_id", "score", "rank")


@query("j7_dense_top6", """
SELECT query_id, entry_id, similarity, rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS entry_id,
    round(greatest(0.0, least(1.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS similarity,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(greatest(0.0, least(1.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b) WHERE rank <= 6""")
def j7_dense_top6(spark, sf):
    rows = table(spark, sf, "embeddings")
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    corpus = rows.select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vector"))
    return nearest(queries, corpus, 6)


@query("j7_cosine", """
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 6) AS similarity FROM embeddings""")
def j7_cosine(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rows.select("vec_id", F.round(cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("similarity"))


@query("j8_hashed_vectors")
def j8_hashed_vectors(spark, sf):
    return hashed_vectors(docs(spark, sf), "text").select("doc_id", "vector")


# Ranked lists over the parts a customer ordered: by price, by quantity and by discount.
LISTS = """
li AS (SELECT o_custkey, l_partkey, max(l_extendedprice) AS price, max(l_quantity) AS quantity, max(l_discount) AS discount
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
lex AS (SELECT o_custkey, l_partkey, price / 262144.0 AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY price DESC, l_partkey) AS rank FROM li),
den AS (SELECT o_custkey, l_partkey, quantity / 50.0 AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY quantity DESC, l_partkey) AS rank FROM li),
see AS (SELECT o_custkey, l_partkey, row_number() OVER (PARTITION BY o_custkey ORDER BY l_partkey) AS rank FROM li WHERE discount >= 0.09),
lists AS (SELECT o_custkey, l_partkey, 'lexical' AS list, score, 0.8 / (20 + rank) AS share, 1 AS o, rank FROM lex WHERE rank <= 15
  UNION ALL SELECT o_custkey, l_partkey, 'dense', score, 1.0 / (20 + rank), 2, rank FROM den WHERE rank <= 15
  UNION ALL SELECT o_custkey, l_partkey, 'seed', 1.0, 4.0 / rank, 0, rank FROM see),
fused AS MATERIALIZED (SELECT CAST(o_custkey AS VARCHAR) AS query_id, CAST(l_partkey AS VARCHAR) AS entry_id,
  coalesce(max(score) FILTER (list = 'lexical'), max(1.0) FILTER (list = 'seed')) AS lexical_score,
  coalesce(max(score) FILTER (list = 'dense'), max(1.0) FILTER (list = 'seed')) AS dense_score,
  count_if(list = 'seed') > 0 AS is_seed, sum(CAST(share AS DOUBLE)) AS fused_score, min(o * 1000 + rank) AS place FROM lists GROUP BY ALL),
cut AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, 12) DESC, place, entry_id) AS rank FROM fused) WHERE rank <= 20)"""


def fused_lists(spark, sf):
    from spendlens.operators.ranking import top_n

    sold = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    li = sold.groupBy(
        F.col("o_custkey").cast("string").alias("query_id"), F.col("l_partkey").alias("part")
    ).agg(F.max("l_extendedprice").alias("price"), F.max("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"))
    entry = F.col("part").cast("string").alias("entry_id")
    lexical = top_n(li, ["query_id"], [F.desc("price"), F.asc("part")], 15).select(
        "query_id", entry, (F.col("price") / 262144.0).alias("score"), "rank")
    dense = top_n(li, ["query_id"], [F.desc("quantity"), F.asc("part")], 15).select(
        "query_id", entry, (F.col("quantity") / 50.0).alias("score"), "rank")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("part"))
    seeds = li.where("discount >= 0.09").select("query_id", entry, F.lit(1.0).alias("score"), place.alias("rank"))
    return fuse(lexical, dense, seeds)


@query("j9_fusion", q.with_(LISTS) + """
SELECT query_id, entry_id, round(lexical_score, 9) AS lexical_score, dense_score, is_seed, round(fused_score, 9) AS fused_score FROM fused""")
def j9_fusion(spark, sf):
    return fused_lists(spark, sf).select(
        "query_id", "entry_id", F.round("lexical_score", 9).alias("lexical_score"), "dense_score", "is_seed", F.round("fused_score", 9).alias("fused_score")
    )


@query("j10_candidate_cut", q.with_(LISTS) + " SELECT query_id, entry_id, rank FROM cut")
def j10_candidate_cut(spark, sf):
    return cut(fused_lists(spark, sf)).select("query_id", "entry_id", "rank")


NAMED_CUT = """
named_cut AS (SELECT c.*, p.p_name AS canonical_name, 'red bolt ' || lower(o.c_mktsegment) AS query,
  (SELECT count(*) FROM (SELECT DISTINCT unnest(regexp_extract_all(lower('red bolt ' || lower(o.c_mktsegment)), '[a-z0-9]+')) AS w)
    WHERE list_contains(string_split(p.p_name, ' '), w)) * 1.0 /
  len(list_distinct(regexp_extract_all(lower('red bolt ' || lower(o.c_mktsegment)), '[a-z0-9]+'))) AS overlap
  FROM cut c JOIN part p ON CAST(p.p_partkey AS VARCHAR) = c.entry_id JOIN customer o ON CAST(o.c_custkey AS VARCHAR) = c.query_id)"""


def named_cut(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("entry_id"), F.col("p_name").alias("canonical_name"))
    asked = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("query_id"), F.concat(F.lit("red bolt "), F.lower("c_mktsegment")).alias("query")
    )
    return cut(fused_lists(spark, sf)).join(parts, "entry_id").join(asked, "query_id")


@query("j11_rerank", q.with_(LISTS, NAMED_CUT) + """
SELECT query_id, entry_id, round(overlap, 6) AS rerank_score FROM named_cut""")
def j11_rerank(spark, sf):
    scored = rerank(named_cut(spark, sf), "query", "canonical_name", "overlap")
    return scored.select("query_id", "entry_id", F.round("rerank_score", 6).alias("rerank_score"))


CHOSEN = """
best AS (SELECT query_id, arg_max(entry_id, overlap * 1000 - rank) AS r_entry, max(overlap) AS r_score,
    arg_min(entry_id, rank) AS f_entry FROM named_cut GROUP BY query_id),
chosen AS (SELECT b.query_id, CASE WHEN r_score >= 0.58 THEN r_entry ELSE f_entry END AS entry_id,
    CASE WHEN r_score >= 0.58 THEN 'rerank' ELSE 'dense_lexical' END AS strategy FROM best b)
SELECT c.query_id, c.entry_id, c.strategy, CASE WHEN is_seed THEN n.query ELSE canonical_name END AS matched_alias,
  round(CASE WHEN c.strategy = 'rerank' THEN overlap ELSE greatest(coalesce(dense_score, 0), coalesce(lexical_score, 0)) END, 6) AS similarity
FROM chosen c JOIN named_cut n ON c.query_id = n.query_id AND c.entry_id = n.entry_id
WHERE c.strategy = 'rerank' OR greatest(coalesce(dense_score, 0), coalesce(lexical_score, 0)) >= 0.58"""


@query("j11_j13_choose", q.with_(LISTS, NAMED_CUT) + "," + CHOSEN)
def j11_j13_choose(spark, sf):
    scored = rerank(named_cut(spark, sf), "query", "canonical_name", "overlap")
    return choose(scored, "query").select(
        "query_id", "entry_id", "strategy", "matched_alias", F.round("similarity", 6).alias("similarity")
    )


@query("j12_fallback", q.with_(LISTS, NAMED_CUT) + """
SELECT query_id, entry_id, 'dense_lexical' AS strategy, round(greatest(coalesce(dense_score, 0), coalesce(lexical_score, 0)), 6) AS similarity
FROM named_cut WHERE rank = 1 AND greatest(coalesce(dense_score, 0), coalesce(lexical_score, 0)) >= 0.58""")
def j12_fallback(spark, sf):
    scored = rerank(named_cut(spark, sf), "query", "canonical_name", None)
    return choose(scored, "query").select("query_id", "entry_id", "strategy", F.round("similarity", 6).alias("similarity"))


GATED = """
gated AS (SELECT l_orderkey * 10 + l_linenumber AS k, CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'exact' WHEN 1 THEN 'rerank' ELSE 'dense_lexical' END AS strategy,
  l_quantity / 50.0 AS similarity, 1 - l_discount * 3 AS mapping_confidence, l_returnflag, l_suppkey,
  CASE WHEN l_returnflag <> 'R' THEN 'Shopping & Retail' END AS category,
  CASE WHEN l_suppkey % 2 = 0 THEN 'gas station, fuel' WHEN l_suppkey % 3 = 0 THEN 'pizza restaurant; pharmacy drugstore' ELSE '' END AS context,
  CASE WHEN l_linenumber % 2 = 0 THEN 'shop' ELSE '' END AS metadata FROM lineitem)"""


@query("r9_r12_gates", q.with_(GATED) + """
SELECT strategy, coalesce(strategy <> 'rerank' AND similarity >= 0.9 AND mapping_confidence >= 0.82 AND category IS NOT NULL, false) AS direct,
  coalesce(similarity >= CASE WHEN strategy = 'dense_lexical' THEN 0.80 ELSE 0.68 END AND metadata <> '', false) AS enrich,
  CASE WHEN context = 'gas station, fuel' THEN 'Transportation' WHEN context <> '' THEN 'Healthcare & Medical' END AS override, count(*) AS n
FROM gated GROUP BY ALL""")
def r9_r12_gates(spark, sf):
    supplier = F.col("l_suppkey")
    rows = table(spark, sf, "lineitem").select(
        F.when(F.col("l_partkey") % 3 == 0, "exact").when(F.col("l_partkey") % 3 == 1, "rerank").otherwise("dense_lexical").alias("strategy"),
        (F.col("l_quantity") / 50.0).alias("similarity"),
        (1 - F.col("l_discount") * 3).alias("mapping"),
        F.when(F.col("l_returnflag") != "R", "Shopping & Retail").alias("category"),
        F.when(supplier % 2 == 0, "gas station, fuel").when(supplier % 3 == 0, "pizza restaurant; pharmacy drugstore").otherwise("").alias("context"),
        F.when(F.col("l_linenumber") % 2 == 0, "shop").otherwise("").alias("metadata"),
    )
    return rows.groupBy(
        "strategy",
        direct_gate(F.col("strategy"), F.col("similarity"), F.col("mapping"), F.col("category")).alias("direct"),
        enrich_gate(F.col("strategy"), F.col("similarity"), F.col("metadata")).alias("enrich"),
        descriptor_override(F.col("context"), F.col("category")).alias("override"),
    ).agg(F.count("*").alias("n"))


def stored_entries(spark, sf):
    """Entries written out, the way a store holds them."""
    return cut_lineage(kb_entries(spark, sf))


def knowledge(spark, sf, lexical="bm25", dense=False):
    entries = stored_entries(spark, sf)
    return index_knowledge(entries, alias_table(entries), lexical, dense)


class Letters:
    """A plain encoder: counts of letters and digits in a text, and one for every text."""

    def encode(self, texts):
        return np.array([[1.0, *(t.lower().count(c) for c in SIGNS)] for t in texts], dtype=np.float32)


SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"

def opened(brand: str) -> str:
    """Texts by their exact aliases, then by those of their brand, and what stays open."""
    return f"""
asked AS (SELECT text, {q.clean("text")} AS query, {brand} AS brand_query, brand_tokens, descriptor_tokens FROM dec),
first_look AS (SELECT a.*, i.entry_ids, coalesce(i.n, 0) AS n, {q.clean("brand_query")} AS cleaned_brand
  FROM asked a LEFT JOIN ids i ON i.alias = a.query WHERE length(query) >= 3),
second_look AS (SELECT f.* EXCLUDE (cleaned_brand), b.entry_ids AS brand_ids, coalesce(b.n, 0) AS brand_n, brand FROM (
    SELECT *, CASE WHEN brand_query <> '' AND brand_query <> query AND length(cleaned_brand) >= 3 THEN cleaned_brand END AS brand
    FROM first_look WHERE n <> 1) f LEFT JOIN ids b ON b.alias = f.brand),
open AS MATERIALIZED (SELECT * FROM second_look WHERE brand_n <> 1),
exact_found AS (SELECT text, entry_ids AS entry_id, query AS matched_alias FROM first_look WHERE n = 1
  UNION ALL SELECT text, brand_ids, brand FROM second_look WHERE brand_n = 1),
seed_ids AS (SELECT text, unnest(string_split(entry_ids, '|')) AS entry_id, generate_subscripts(string_split(entry_ids, '|'), 1) AS o FROM open WHERE n > 0
  UNION ALL SELECT text, unnest(string_split(brand_ids, '|')), 100 + generate_subscripts(string_split(brand_ids, '|'), 1) FROM open WHERE brand_n > 0),
seed AS (SELECT text, entry_id, row_number() OVER (PARTITION BY text ORDER BY min(o)) AS rank FROM seed_ids GROUP BY text, entry_id)"""


LEX_BM25 = """
role_list AS (SELECT text, query, list_filter(list_transform(string_split(brand_tokens || ' ' || descriptor_tokens, ' '),
  lambda x: regexp_replace(upper(x), '[^A-Z0-9]', '', 'g')), lambda x: length(x) >= 2)[1:8] AS w FROM open),
asked_terms AS (SELECT text, unnest(list_transform(CASE WHEN len(w) > 0 THEN w ELSE
  list_filter(regexp_extract_all(query, '[A-Z0-9]+'), lambda x: length(x) >= 2)[1:8] END, lambda x: lower(x))) AS term FROM role_list),
lex_scores AS (SELECT text, id AS entry_id, round(sum(weight), 12) AS score FROM asked_terms JOIN post_e USING (term) GROUP BY ALL),
lex AS (SELECT text, entry_id, 1.0 / rank AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, entry_id) AS rank FROM lex_scores WHERE score > 0) WHERE rank <= 15)"""

LEX_TFIDF = f"""
corpus AS (SELECT entry_id, document AS text FROM entries),
wanted AS (SELECT text AS asked_text, query AS text FROM open),
{grams("corpus", "entry_id")},
{grams("wanted", "asked_text")},
idf AS MATERIALIZED (SELECT term, ln((1.0 + (SELECT count(*) FROM entries)) / (1.0 + count(*))) + 1.0 AS idf FROM tf_corpus GROUP BY term),
wd AS (SELECT id, term, tf * idf AS w FROM tf_corpus JOIN idf USING (term)),
nd AS (SELECT id, sqrt(sum(w * w)) AS norm FROM wd GROUP BY id),
wq AS (SELECT id, term, tf * idf AS w FROM tf_wanted JOIN idf USING (term)),
nq AS (SELECT id, sqrt(sum(w * w)) AS norm FROM wq GROUP BY id),
lex_scores AS (SELECT wq.id AS text, wd.id AS entry_id, round(sum(wq.w / nq.norm * wd.w / nd.norm), 12) AS score
  FROM wq JOIN wd USING (term) JOIN nq ON nq.id = wq.id JOIN nd ON nd.id = wd.id GROUP BY ALL),
lex AS (SELECT text, entry_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, entry_id) AS rank FROM lex_scores WHERE score > 0) WHERE rank <= 15)"""


def letters(text: str) -> str:
    """The vector of `Letters`, scaled to unit length in single precision as an encoder's vectors are."""
    counts = f"list_transform(string_split('{SIGNS}', ''), lambda c: CAST(length(lower({text})) - length(replace(lower({text}), c, '')) AS DOUBLE))"
    return f"list_concat([CAST(1 AS DOUBLE)], {counts})"


DENSE = f"""
raw_vectors AS (SELECT 'q' AS side, text AS id, {letters("CASE WHEN length(brand_query) >= 3 THEN brand_query ELSE query END")} AS v FROM open
  UNION ALL SELECT 'e', entry_id, {letters("document")} FROM entries),
vectors AS MATERIALIZED (SELECT side, id, list_transform(v, lambda x: CAST(CAST(CAST(x AS FLOAT) /
  CAST(sqrt(list_sum(list_transform(v, lambda y: y * y))) AS FLOAT) AS FLOAT) AS DOUBLE)) AS v FROM raw_vectors),
den AS (SELECT text, entry_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, entry_id) AS rank FROM (
    SELECT a.id AS text, b.id AS entry_id, round(greatest(0.0, least(1.0, list_cosine_similarity(a.v, b.v))), 6) AS score
    FROM vectors a, vectors b WHERE a.side = 'q' AND b.side = 'e')) WHERE rank <= 15)"""
ONE = "CAST(1 AS DOUBLE)"
NO_DENSE = "den AS (SELECT text, entry_id, score, rank FROM lex WHERE false)"


def fused_and_chosen(scored: bool) -> str:
    words = rf"regexp_extract_all({{}}, '[\p{{{{L}}}}\p{{{{N}}}}]+')".replace("{{", "{").replace("}}", "}")
    asked, held = (words.replace("{}", q.fold_accents(c)) for c in ("o.query", "e.document"))
    overlap = f"""CASE WHEN len(list_distinct({asked})) > 0 THEN
      len(list_intersect(list_distinct({asked}), {held})) * {ONE} / len(list_distinct({asked})) ELSE 0 * {ONE} END"""
    return f"""
candidate_lists AS (SELECT text, entry_id, 'lexical' AS list, CAST(score AS DOUBLE) AS score, 0.8 / (20 + rank) AS share, 1000 + rank AS place FROM lex
  UNION ALL SELECT text, entry_id, 'dense', score, 1.0 / (20 + rank), 2000 + rank FROM den
  UNION ALL SELECT text, entry_id, 'seed', {ONE}, 4.0 / rank, rank FROM seed),
fused AS (SELECT text, entry_id,
  coalesce(max(score) FILTER (list = 'lexical'), max({ONE}) FILTER (list = 'seed')) AS lexical_score,
  coalesce(max(score) FILTER (list = 'dense'), max({ONE}) FILTER (list = 'seed')) AS dense_score,
  count_if(list = 'seed') > 0 AS is_seed, sum(CAST(share AS DOUBLE)) AS fused_score, min(place) AS place FROM candidate_lists GROUP BY ALL),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY round(fused_score, 12) DESC, place, entry_id) AS rank
  FROM fused) WHERE rank <= 20),
judged AS (SELECT r.*, o.query, e.canonical_name, greatest(coalesce(dense_score, 0), coalesce(lexical_score, 0)) AS own,
    {overlap if scored else "CAST(NULL AS DOUBLE)"} AS overlap
  FROM ranked r JOIN open o ON o.text = r.text JOIN entries e ON e.entry_id = r.entry_id),
best AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY overlap DESC NULLS LAST, rank) AS by_overlap FROM judged),
chosen AS (SELECT text, max(CASE WHEN by_overlap = 1 AND overlap >= 0.58 THEN 1 ELSE 0 END) AS reranked FROM best GROUP BY text),
fused_found AS (SELECT b.text, entry_id, CASE WHEN is_seed THEN query ELSE canonical_name END AS matched_alias,
    CASE reranked WHEN 1 THEN overlap ELSE own END AS similarity, CASE reranked WHEN 1 THEN 'rerank' ELSE 'dense_lexical' END AS strategy,
    dense_score, lexical_score, fused_score, CASE reranked WHEN 1 THEN overlap END AS rerank_score
  FROM best b JOIN chosen c ON c.text = b.text
  WHERE CASE reranked WHEN 1 THEN by_overlap = 1 ELSE rank = 1 AND own >= 0.58 END),
matches AS (SELECT text, entry_id, matched_alias, {ONE} AS similarity, 'exact' AS strategy, {ONE} AS dense_score, {ONE} AS lexical_score,
    {ONE} AS fused_score, {ONE} AS rerank_score FROM exact_found
  UNION ALL SELECT * FROM fused_found)"""


FOUND = """
SELECT a.text, a.query, entry_id, matched_alias, round(similarity, 6) AS similarity, strategy, round(dense_score, 6) AS dense_score,
  round(lexical_score, 6) AS lexical_score, round(fused_score, 6) AS fused_score, round(rerank_score, 6) AS rerank_score
FROM asked a LEFT JOIN matches m ON m.text = a.text"""
FULL_SEARCH = [
    *KB_CTES, PLACE_ALIAS, q.TXN, q.CLEANED, CLEAN_TEXTS, branded_roles("aliases"), DECOMPOSED, LOOKUP, opened("brand_query"),
    bm25("entries", "entry_id", "document", "e"), LEX_BM25, DENSE, fused_and_chosen(True),
]


def as_found(found):
    scores = ["similarity", "dense_score", "lexical_score", "fused_score", "rerank_score"]
    return found.select(
        "text", "query", "entry_id", "matched_alias", "strategy", *[F.round(c, 6).alias(c) for c in scores]
    )


def full_knowledge(spark, sf):
    """Stored entries with a stored BM25 index and kept vectors of an external encoder."""
    entries = stored_entries(spark, sf)
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index = build_index(entries, "entry_id", "document", root, bins=8)
    kept = f"{root}-vectors"
    vectors = stored_vectors(entries.select("entry_id", "document"), "document", kept, Letters()).select("entry_id", "vector")
    return Knowledge(entries, alias_table(entries), index, None, cut_lineage(vectors), kept)


@query("j14_search_tokens", recursive(*FULL_SEARCH) + FOUND)
def j14_search_tokens(spark, sf):
    return as_found(search(distinct_texts(spark, sf), full_knowledge(spark, sf), scorer="overlap", encoder=Letters()))


@query("j14_search_plain", recursive(*KB_CTES, PLACE_ALIAS, q.TXN, q.CLEANED, CLEAN_TEXTS, role_ctes("texts"), DECOMPOSED, LOOKUP,
       opened("text"), LEX_TFIDF, NO_DENSE, fused_and_chosen(False)) + FOUND)
def j14_search_plain(spark, sf):
    return as_found(search(distinct_texts(spark, sf), knowledge(spark, sf, "tfidf"), use_tokens=False))


OVERRIDES = "MAP {" + ", ".join(f"{q.lit(h)}: {q.lit(c)}" for h, c in OVERRIDE_HINTS.items()) + "}"
CASCADE = f"""
ruled_open AS (SELECT DISTINCT cleaned FROM ruled WHERE direction IS NULL AND rule IS NULL AND cleaned <> ''),
answered AS (SELECT m.text, m.strategy, m.similarity, e.mapped_category, e.mapping_confidence, e.metadata_text, e.display_name,
    e.canonical_name, e.labels, coalesce(c.descriptor_context, '') AS descriptor_context, coalesce(m.strategy <> 'rerank' AND
      m.similarity >= 0.9 AND e.mapping_confidence >= 0.82 AND e.mapped_category IS NOT NULL, false) AS direct
  FROM ruled_open o JOIN asked a ON a.text = o.cleaned LEFT JOIN matches m ON m.text = a.text
  LEFT JOIN entries e ON e.entry_id = m.entry_id LEFT JOIN context c ON c.text = a.text),
kb AS (SELECT text, coalesce(list_filter(list_transform(string_split(descriptor_context, '; '), lambda h: {OVERRIDES}[h]),
    lambda x: x IS NOT NULL)[1], mapped_category) AS category FROM answered WHERE direct)
SELECT coalesce(direction, rule, kb.category) AS category,
  CASE WHEN direction IS NOT NULL THEN 'direction' WHEN rule IS NOT NULL THEN 'rules' WHEN kb.category IS NOT NULL THEN 'knowledge_base' END AS source,
  coalesce(direction, rule, kb.category) IS NULL AS flagged_for_review, count(*) AS n
FROM txn t JOIN ruled r ON t.raw = r.raw LEFT JOIN kb ON kb.text = r.cleaned AND direction IS NULL AND rule IS NULL GROUP BY ALL"""


@query("r8_cascade", recursive(*FULL_SEARCH) + "," + CASCADE)
def r8_cascade(spark, sf):
    rows = classify(txn(spark, sf), "raw", kb=full_knowledge(spark, sf), scorer="overlap", encoder=Letters())
    return rows.groupBy("category", "source", "flagged_for_review").agg(F.count("*").alias("n"))


class ByLength:
    """A stand-in model: category and confidence follow from the length of the text it is given."""

    def __init__(self, shift):
        self.shift = shift

    def score(self, df, text):
        kept = [c for c in df.columns if c not in ("category", "confidence")]
        category = F.get(F.array(*map(F.lit, CATEGORIES)), (F.length(text) + self.shift) % len(CATEGORIES))
        confidence = (F.pmod(F.length(text) * 7 + self.shift * 11, F.lit(60)) + 40) / 100.0
        return df.select(*kept, category.alias("category"), confidence.alias("confidence"))


def by_length(shift: int) -> str:
    names = "[" + ", ".join(map(q.lit, CATEGORIES)) + "]"
    return f"""{names}[(length(model_text) + {shift}) % {len(CATEGORIES)} + 1] AS category{shift},
    ((length(model_text) * 7 + {shift * 11}) % 60 + 40) / CAST(100 AS DOUBLE) AS confidence{shift}"""


STAGES = CASCADE[: CASCADE.index("SELECT coalesce(direction, rule, kb.category)")].rstrip() + f""",
identified AS (SELECT *, coalesce(CASE WHEN display_name <> '' THEN display_name END, canonical_name) AS identity,
    coalesce(similarity >= CASE strategy WHEN 'dense_lexical' THEN 0.80 ELSE 0.68 END AND metadata_text <> '', false) AS enriched
  FROM answered WHERE NOT direct),
model_input AS (SELECT text, enriched, concat_ws('. ', text,
    CASE WHEN enriched AND identity <> text THEN 'merchant identity: ' || identity END,
    CASE WHEN enriched AND metadata_text <> '' THEN 'external metadata: ' || metadata_text END,
    CASE WHEN enriched AND labels <> '' THEN 'place types: ' || array_to_string(string_split(labels, '|')[1:3], '; ') END,
    CASE WHEN descriptor_context <> '' THEN 'descriptor context: ' || descriptor_context END) AS model_text FROM identified
  UNION ALL SELECT DISTINCT cleaned, false, '' FROM ruled WHERE direction IS NULL AND rule IS NULL AND cleaned = ''),
scored AS (SELECT *, {by_length(0)}, {by_length(3)} FROM model_input),
modelled AS (SELECT text, confidence0 < 0.6 AND confidence3 >= 0.6 AS changed,
    CASE WHEN confidence0 < 0.6 AND confidence3 >= 0.6 THEN category3 ELSE category0 END AS category,
    CASE WHEN confidence0 < 0.6 AND confidence3 >= 0.6 THEN confidence3 ELSE confidence0 END AS confidence,
    CASE WHEN confidence0 < 0.6 AND confidence3 >= 0.6 THEN 'second' WHEN enriched THEN 'first_metadata' ELSE 'first' END AS source FROM scored)
SELECT coalesce(direction, rule, kb.category, m.category) AS category,
  CASE WHEN direction IS NOT NULL THEN 'direction' WHEN rule IS NOT NULL THEN 'rules' WHEN kb.category IS NOT NULL THEN 'knowledge_base' ELSE m.source END AS source,
  CASE WHEN coalesce(direction, rule, kb.category) IS NULL THEN cleaned = '' OR m.confidence < 0.70 ELSE cleaned = '' END AS flagged_for_review, count(*) AS n
FROM txn t JOIN ruled r ON t.raw = r.raw LEFT JOIN kb ON kb.text = r.cleaned AND direction IS NULL AND rule IS NULL
LEFT JOIN modelled m ON m.text = r.cleaned AND direction IS NULL AND rule IS NULL GROUP BY ALL"""


@query("r13_cascade_stages", recursive(*FULL_SEARCH) + "," + STAGES)
def r13_cascade_stages(spark, sf):
    """The cascade with enriched texts, a ladder of models and a second opinion."""
    rows = classify(
        txn(spark, sf), "raw", kb=full_knowledge(spark, sf), stages=[None, Stage("first", ByLength(0))],
        second=Stage("second", ByLength(3)), scorer="overlap", encoder=Letters(), options=Options(use_second_opinion=True),
    )
    return rows.groupBy("category", "source", "flagged_for_review").agg(F.count("*").alias("n"))


@query("j15_attach_labels", q.with_(q.TXN, q.CLEANED) + """
, labels15 AS (SELECT cleaned, CASE WHEN length(cleaned) % 2 = 0 THEN 'Income' END AS category FROM (SELECT DISTINCT cleaned FROM raw_clean) WHERE length(cleaned) % 3 <> 0)
SELECT t.txn_key, r.cleaned, l.category AS label FROM txn t JOIN raw_clean r ON t.raw = r.raw LEFT JOIN labels15 l ON l.cleaned = r.cleaned""")
def j15_attach_labels(spark, sf):
    from spendlens.functions.cleaning import with_clean

    rows = with_clean(txn(spark, sf).select("txn_key", "raw"), "raw")
    labels = rows.select("cleaned").distinct().where(F.length("cleaned") % 3 != 0).select(
        F.col("cleaned").alias("description"), F.when(F.length("cleaned") % 2 == 0, "Income").alias("category")
    )
    return attach_labels(rows, labels, "cleaned", "label").select("txn_key", "cleaned", "label")


@query("k_index_words", f"""
SELECT doc_id, md5(array_to_string(regexp_extract_all({q.fold_accents("text")}, '[\\p{{L}}\\p{{N}}]+'), ' ')) AS digest FROM documents""")
def k_index_words(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(F.concat_ws(" ", index_words(F.col("text")))).alias("digest"))
