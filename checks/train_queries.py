"""Training-set jobs and classifiers."""

from pyspark.sql import functions as F

from checks import sql as q
from checks.kb_queries import KB_CTES, PLACE_ALIAS
from checks.registry import query
from checks.views import judged, kb_entries, table, true_label, txn
from spendlens.functions.cleaning import with_clean
from spendlens.operators import models as m
from spendlens.operators import training as tr
from spendlens.operators.dense import nearest
from spendlens.session import cut_lineage

IDS = ["raw"]
UNIQUE = """, u AS MATERIALIZED (SELECT raw, any_value(cleaned) AS cleaned, min(label) AS category FROM judged WHERE label IS NOT NULL AND cleaned <> '' GROUP BY raw),
d AS MATERIALIZED (SELECT *, md5('42:' || raw) AS digest FROM u)"""
J = q.with_(q.TXN, q.CLEANED, q.JUDGED) + UNIQUE


def unique(spark, sf):
    """One row per raw text with its cleaned text and first label. Rows of a text differ in the label alone, so a text is
    cleaned once."""
    labelled = txn(spark, sf).select("raw", true_label().alias("label")).where("label IS NOT NULL").distinct()
    rows = with_clean(labelled.groupBy("raw").agg(F.min("label").alias("category")), "raw")
    return rows.where("cleaned <> ''").select("raw", "cleaned", "category")


@query("t1_stratified_split", J + """
, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY digest) AS rn, count(*) OVER (PARTITION BY category) AS n FROM d)
SELECT raw, category, CASE WHEN rn <= floor(n * 0.8) THEN 'train' WHEN rn <= floor(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM r""")
def t1_stratified_split(spark, sf):
    return tr.stratified_split(unique(spark, sf), IDS, "category").select("raw", "category", "split")


@query("t2_stratified_sample", J + """
SELECT raw, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY digest) AS rn FROM d) WHERE rn <= 50""")
def t2_stratified_sample(spark, sf):
    return tr.stratified_sample(unique(spark, sf), IDS, "category", 500).select("raw", "category")


@query("t3_uniform_sample", J + " SELECT raw, category FROM d ORDER BY digest LIMIT 200")
def t3_uniform_sample(spark, sf):
    return tr.uniform_sample(unique(spark, sf), IDS, 200).select("raw", "category")


def hexnum(digest: str, part: int) -> str:
    return f"CAST('0x' || substr({digest}, {1 + 7 * part}, 7) AS BIGINT)"


FORMS = f"""
, w AS (SELECT *, string_split(cleaned, ' ') AS ws, {hexnum("digest", 0)} AS h0, {hexnum("digest", 1)} AS h1 FROM d),
f AS (SELECT *, [
  rtrim(substr(cleaned, 1, CAST(15 + h1 % 11 AS INT))),
  array_to_string(list_transform(ws, lambda x: substr(x, 1, 1) || regexp_replace(substr(x, 2), '[AEIOU]', '', 'g')), ' '),
  array_to_string(list_transform(ws, lambda x: substr(x, 1, 2) || regexp_replace(substr(x, 3), '[AEIOU]', '', 'g')), ' '),
  array_to_string(list_concat([substr(ws[1], 1, 4)], ws[2:]), ' '),
  array_to_string(ws[1:greatest(len(ws) - 1, 1)], ' '),
  CASE WHEN len(ws) > 1 THEN array_to_string(list_transform(ws, lambda x: substr(x, 1, 1)), '') ELSE cleaned END] AS forms FROM w),
v AS (SELECT raw, category, cleaned, 0 AS k, cleaned AS form FROM f UNION ALL
  SELECT raw, category, cleaned, k + 1, forms[CAST((h0 + k) % 6 + 1 AS INT)] FROM f, (VALUES (0), (1), (2)) t(k)
  WHERE forms[CAST((h0 + k) % 6 + 1 AS INT)] NOT IN ('', cleaned)),
g AS (SELECT raw, category, form, min(k) AS k FROM v GROUP BY ALL)
SELECT raw, category, form AS cleaned, CAST(row_number() OVER (PARTITION BY raw ORDER BY k) - 1 AS INT) AS variant FROM g"""


@query("t4_augment", J + FORMS)
def t4_augment(spark, sf):
    return tr.augment(unique(spark, sf), IDS, "cleaned").select("raw", "category", "cleaned", "variant")


POOL = """, pool AS (SELECT DISTINCT mapped_category AS category, lab.label FROM entries e, LATERAL (SELECT unnest(string_split(e.labels, '|')) AS label) lab
  WHERE mapped_category IS NOT NULL AND e.labels <> ''),
single(labels) AS (SELECT DISTINCT label FROM pool),""" + q.label_map("single", "own_").lstrip()


@query("t5_label_pool", q.with_(*KB_CTES) + POOL + """
, kept AS (SELECT p.category, p.label FROM pool p JOIN own_label_map m ON m.labels = p.label AND m.category = p.category)
SELECT category, label, row_number() OVER (PARTITION BY category ORDER BY md5(label)) - 1 AS idx, count(*) OVER (PARTITION BY category) AS size FROM kept""")
def t5_label_pool(spark, sf):
    return tr.label_pool(kb_entries(spark, sf)).select("category", "label", "idx", "size")


@query("t5_location_pool", q.with_(*KB_CTES) + """
, p AS (SELECT DISTINCT concat_ws(', ', locality, region, country) AS place FROM entries WHERE locality IS NOT NULL)
SELECT place, row_number() OVER (ORDER BY md5(place)) - 1 AS idx, (SELECT count(*) FROM p) AS size FROM p""")
def t5_location_pool(spark, sf):
    return tr.location_pool(kb_entries(spark, sf)).select("place", "idx", "size")


DRAWS = f"""
, lp AS MATERIALIZED (SELECT p.category, p.label, row_number() OVER (PARTITION BY p.category ORDER BY md5(p.label)) - 1 AS idx,
    count(*) OVER (PARTITION BY p.category) AS size FROM pool p JOIN own_label_map m ON m.labels = p.label AND m.category = p.category),
cls AS (SELECT category, any_value(size) AS size, row_number() OVER (ORDER BY category) - 1 AS pos FROM lp GROUP BY category),
lo AS (SELECT DISTINCT concat_ws(', ', locality, region, country) AS place FROM entries WHERE locality IS NOT NULL),
loc AS (SELECT place, row_number() OVER (ORDER BY md5(place)) - 1 AS idx FROM lo),
u AS (SELECT raw, any_value(cleaned) AS cleaned, min(label) AS category FROM judged WHERE label IS NOT NULL AND cleaned <> '' GROUP BY raw),
d AS (SELECT *, md5('42:' || raw) AS digest FROM u),
h AS (SELECT *, {hexnum("digest", 0)} AS h0, {hexnum("digest", 1)} AS h1, {hexnum("digest", 2)} AS h2, {hexnum("digest", 3)} AS h3,
   {hexnum("md5(digest)", 0)} AS h4, {hexnum("md5(digest)", 1)} AS h5, (SELECT count(*) FROM cls) AS nc, (SELECT count(*) FROM loc) AS nl FROM d),
tg AS (SELECT h.*, CASE WHEN h0 % 100 < 50 THEN CASE WHEN h2 % 100 < 8 AND nc > 1 THEN (o.pos + 1 + h4 % greatest(nc - 1, 1)) % nc ELSE o.pos END END AS pos
   FROM h LEFT JOIN cls o ON o.category = h.category),
pk AS (SELECT tg.*, c.category AS cat, h5 % c.size AS idx, CASE WHEN c.category IS NOT NULL AND h3 % 100 < 40 AND nl > 0 THEN h4 % nl END AS lidx
   FROM tg LEFT JOIN cls c ON c.pos = tg.pos),
fin AS (SELECT pk.*, lp.label AS lbl, 'place types: ' || lp.label AS types,
   'external metadata: ' || concat_ws('. ', 'place types: ' || lp.label, 'location: ' || loc.place) AS meta
   FROM pk LEFT JOIN lp ON lp.category = pk.cat AND lp.idx = pk.idx LEFT JOIN loc ON loc.idx = pk.lidx)
SELECT raw, category, CASE WHEN lbl IS NULL THEN cleaned WHEN h1 % 100 < 30 THEN concat_ws('. ', cleaned, meta, types)
   WHEN h1 % 100 < 55 THEN concat_ws('. ', cleaned, meta) WHEN h1 % 100 < 80 THEN concat_ws('. ', cleaned, types)
   ELSE concat_ws('. ', cleaned, 'merchant identity: ' || array_to_string(list_transform(string_split(lower(cleaned), ' '),
     lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' '), meta, types) END AS model_text FROM fin"""


@query("t6_enriched_training", q.with_(*KB_CTES, q.TXN, q.CLEANED, q.JUDGED) + POOL + DRAWS)
def t6_enriched_training(spark, sf):
    entries = cut_lineage(kb_entries(spark, sf))
    rows = tr.enrich(
        unique(spark, sf), IDS, "cleaned", "category", tr.label_pool(entries).persist(), tr.location_pool(entries).persist()
    )
    return rows.select("raw", "category", "model_text")


@query("t7_distant_pairs", q.with_(*KB_CTES, PLACE_ALIAS) + """
SELECT DISTINCT text, mapped_category AS category FROM (
  SELECT canonical_name AS text, mapped_category FROM entries WHERE mapping_confidence >= 0.5 UNION ALL
  SELECT alias, mapped_category FROM entries e JOIN aliases a ON a.entry_id = e.entry_id WHERE mapping_confidence >= 0.5)
WHERE mapped_category IS NOT NULL""")
def t7_distant_pairs(spark, sf):
    return tr.distant_pairs(kb_entries(spark, sf)).select("text", "category")


@query("t8_positive_pairs", q.with_(*KB_CTES, PLACE_ALIAS) + """
SELECT DISTINCT canonical_name AS anchor, alias AS positive FROM entries e JOIN aliases a ON a.entry_id = e.entry_id WHERE alias <> canonical_name""")
def t8_positive_pairs(spark, sf):
    return tr.positive_pairs(kb_entries(spark, sf))


@query("t8_negative_pairs", q.with_(*KB_CTES) + f"""
, k AS (SELECT entry_id, canonical_name, mapped_category AS category, md5('43:' || entry_id) AS dg,
   row_number() OVER (PARTITION BY mapped_category ORDER BY md5('42:' || entry_id)) AS rn, count(*) OVER (PARTITION BY mapped_category) AS size
   FROM entries WHERE mapped_category IS NOT NULL),
cls AS (SELECT category, any_value(size) AS size, row_number() OVER (ORDER BY category) - 1 AS pos FROM k GROUP BY category),
a AS (SELECT k.*, ({hexnum("dg", 0)} % greatest((SELECT count(*) FROM cls) - 1, 1) + o.pos + 1) % (SELECT count(*) FROM cls) AS p FROM k JOIN cls o ON o.category = k.category)
SELECT a.canonical_name AS anchor, a.category, n.canonical_name AS negative, n.category AS negative_category
FROM a JOIN cls c ON c.pos = a.p JOIN k n ON n.category = c.category AND n.rn = 1 + {hexnum("a.dg", 1)} % c.size""")
def t8_negative_pairs(spark, sf):
    return tr.negative_pairs(cut_lineage(kb_entries(spark, sf)))


@query("t9_pseudo_labels", q.with_(q.TXN, q.CLEANED, q.JUDGED) + """
, s AS (SELECT txn_key, raw, amount, category, confidence, (rank() OVER (PARTITION BY category ORDER BY confidence DESC) - 1)
  / nullif(count(*) OVER (PARTITION BY category) - 1, 0) AS share FROM judged)
SELECT txn_key, raw, amount, category, confidence FROM s WHERE confidence >= CASE WHEN category = 'Income' THEN 0.95 ELSE 0.9 END AND coalesce(share, 0) <= 0.2""")
def t9_pseudo_labels(spark, sf):
    rows = judged(spark, sf).select("txn_key", "raw", "amount", "category", "confidence")
    return tr.pseudo_labels(rows, class_thresholds={"Income": 0.95})


def scored(spark, sf, kind):
    parts = tr.stratified_split(unique(spark, sf), IDS, "category").persist()
    model = m.train_text_model(parts.where("split = 'train'"), kind=kind)
    kept = parts.where("split <> 'train'").withColumnRenamed("category", "label")
    return model.score(kept, "cleaned").select("raw", "label", "category", F.round("confidence", 4).alias("confidence"))


@query("m1_linear_model")
def m1_linear_model(spark, sf):
    return scored(spark, sf, "linear")


@query("m2_subword_model")
def m2_subword_model(spark, sf):
    return scored(spark, sf, "subword")


VECTORS = """
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, vec_id % 5 = 0 AS test FROM embeddings)"""


def vectors(spark, sf):
    rows = table(spark, sf, "embeddings").withColumnRenamed("embedding", "vector")
    return rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0")


@query("m3_centroids", q.with_(VECTORS) + """
, p AS (SELECT label, unnest(generate_series(1, len(e))) AS pos, unnest(e) AS x FROM v WHERE NOT test)
SELECT label, pos, round(avg(x), 6) AS mean FROM p GROUP BY ALL""")
def m3_centroids(spark, sf):
    centroids = m.class_centroids(vectors(spark, sf)[0])
    return centroids.select("label", F.posexplode("centroid").alias("i", "mean")).select(
        "label", (F.col("i") + 1).cast("long").alias("pos"), F.round("mean", 6).alias("mean")
    )


@query("m3_nearest_centroid", q.with_(VECTORS) + """
, p AS (SELECT label, unnest(generate_series(1, len(e))) AS pos, unnest(e) AS x FROM v WHERE NOT test),
a AS (SELECT label, pos, avg(x) AS x FROM p GROUP BY ALL),
c AS (SELECT label, list(x ORDER BY pos) AS c FROM a GROUP BY label),
s AS (SELECT vec_id, c.label AS predicted, round(list_cosine_similarity(e, c), 6) AS similarity FROM v, c WHERE test)
SELECT vec_id, predicted, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, predicted) AS r FROM s) WHERE r = 1""")
def m3_nearest_centroid(spark, sf):
    train, test = vectors(spark, sf)
    return m.nearest_centroid(test, m.class_centroids(train)).select("vec_id", "predicted", "similarity")


@query("m3_neighbour_vote", q.with_(VECTORS) + """
, s AS (SELECT a.vec_id, b.vec_id AS other, b.label, round(greatest(0, least(1, list_cosine_similarity(a.e, b.e))), 6) AS sim FROM v a, v b WHERE a.test AND NOT b.test),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other) AS rank FROM s) WHERE rank <= 7),
t AS (SELECT vec_id, label, count(*) AS votes, min(rank) AS closest FROM n GROUP BY ALL)
SELECT vec_id, label AS predicted, votes FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, closest) AS r FROM t) WHERE r = 1""")
def m3_neighbour_vote(spark, sf):
    train, test = vectors(spark, sf)
    near = nearest(
        test.select(F.col("vec_id").alias("query_id"), "vector"), train.select(F.col("vec_id").alias("entry_id"), "vector"), 7
    )
    votes = m.neighbour_vote(near, train.select(F.col("vec_id").alias("entry_id"), "label"))
    return votes.withColumnRenamed("query_id", "vec_id")


@query("r13_cascade_with_model")
def r13_cascade_with_model(spark, sf):
    from checks.search_queries import knowledge
    from spendlens.plans.classify import Stage, classify

    model = m.train_text_model(unique(spark, sf))
    rows = classify(
        txn(spark, sf), "raw", kb=knowledge(spark, sf, lexical=None), stages=[None, Stage("sgd", model)]
    )
    return rows.groupBy("category", "source", "flagged_for_review").agg(F.count("*").alias("n"))
