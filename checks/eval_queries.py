"""Evaluation and quality reports."""

from pyspark.sql import functions as F

from checks import sql as q
from checks.registry import query
from checks.views import judged, table, txn
from spendlens.fixed import CATEGORIES
from spendlens.functions.cleaning import with_clean
from spendlens.operators import evaluate as ev
from spendlens.session import cut_lineage

J = q.with_(q.TXN, q.CLEANED, q.JUDGED)
OK = "(category IS NOT DISTINCT FROM label)"


def rounded(df, *names):
    for name in names:
        df = df.withColumn(name, F.round(name, 6))
    return df


@query("e1_accuracy", J + f"""
SELECT count(*) AS n, count_if({OK}) AS correct, round(avg(CAST({OK} AS INT)), 6) AS accuracy FROM judged""")
def e1_accuracy(spark, sf):
    return rounded(ev.accuracy(judged(spark, sf)), "accuracy")


WEIGHTED = """, w AS (SELECT raw, min(category) AS category, min(label) AS label, count(*) AS occurrence_count FROM judged GROUP BY raw)"""


def unique_rows(spark, sf):
    return judged(spark, sf).groupBy("raw").agg(
        F.min("category").alias("category"), F.min("label").alias("label"), F.count("*").alias("occurrence_count")
    )


@query("e2_weighted_accuracy", J + WEIGHTED + f"""
SELECT CAST(sum(CASE WHEN {OK} THEN occurrence_count ELSE 0 END) AS BIGINT) AS correct, CAST(sum(occurrence_count) AS BIGINT) AS total,
  round(sum(CASE WHEN {OK} THEN occurrence_count ELSE 0 END) / sum(occurrence_count), 6) AS accuracy FROM w""")
def e2_weighted_accuracy(spark, sf):
    return rounded(ev.weighted_accuracy(unique_rows(spark, sf), "occurrence_count"), "accuracy")


def by_key(key: str, rows: str = "judged") -> str:
    return f"""SELECT '{key}' AS dimension, {key} AS value, count(*) AS n, count_if({OK}) AS correct,
  round(count_if({OK}) / count(*), 6) AS accuracy FROM {rows} GROUP BY {key}"""


@query("e3_breakdown", J + " UNION ALL ".join(by_key(k) for k in ("source", "label", "account_type")))
def e3_breakdown(spark, sf):
    return rounded(ev.breakdown(judged(spark, sf), ["source", "label", "account_type"]), "accuracy")


@query("e4_model_only", J + ", m AS (SELECT * FROM judged WHERE source = 'sgd') " + by_key("label", "m") + f"""
UNION ALL SELECT 'all', 'all', count(*), count_if({OK}), round(count_if({OK}) / count(*), 6) FROM m""")
def e4_model_only(spark, sf):
    rows = ev.model_only(judged(spark, sf)).withColumn("all", F.lit("all"))
    return rounded(ev.breakdown(rows, ["label", "all"]), "accuracy")


@query("e5_flag_rates", J + """
SELECT count(*) AS n, round(avg(CAST(flagged_for_review AS INT)), 6) AS flag_rate, round(avg(confidence), 6) AS mean_confidence,
  round(avg(CAST(confidence < 0.7 AS INT)), 6) AS below_threshold FROM judged""")
def e5_flag_rates(spark, sf):
    return rounded(ev.flag_rates(judged(spark, sf)), "flag_rate", "mean_confidence", "below_threshold")


REPORT = f""", c AS (SELECT label AS t, category AS p, count(*) AS n FROM judged WHERE label IS NOT NULL GROUP BY ALL),
classes AS (SELECT t AS label FROM c UNION SELECT p FROM c),
s AS (SELECT l.label, CAST(coalesce((SELECT sum(n) FROM c WHERE t = l.label), 0) AS BIGINT) AS support,
  coalesce((SELECT sum(n) FROM c WHERE p = l.label), 0) AS predicted, coalesce((SELECT sum(n) FROM c WHERE t = l.label AND p = l.label), 0) AS hits FROM classes l),
r AS (SELECT label, support, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM s),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)
SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f
UNION ALL SELECT 'macro avg', CAST(sum(support) AS BIGINT), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM f
UNION ALL SELECT 'weighted avg', CAST(sum(support) AS BIGINT), round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) FROM f"""


@query("e6_class_report", J + REPORT)
def e6_class_report(spark, sf):
    report = ev.class_report(judged(spark, sf).where("label IS NOT NULL"))
    return rounded(report, "precision", "recall", "f1").select("label", "support", "precision", "recall", "f1")


@query("e7_confusion", J + " SELECT label AS \"true\", " + ", ".join(
    f"count_if(category = {q.lit(c)}) AS \"{c}\"" for c in CATEGORIES) + " FROM judged GROUP BY label")
def e7_confusion(spark, sf):
    return ev.confusion_matrix(judged(spark, sf))


@query("e7_diagonal", J + """
SELECT CAST(coalesce(count_if(category = label), 0) AS BIGINT) AS correct, count(*) AS total FROM judged""")
def e7_diagonal(spark, sf):
    return ev.diagonal(judged(spark, sf))


WRONG = f""", wrong AS (SELECT source, label AS "true", category AS pred, count(*) AS n FROM judged WHERE NOT {OK} AND label IS NOT NULL GROUP BY ALL)"""


@query("e8_top_confusions", J + WRONG + """
, t AS (SELECT "true", pred, CAST(sum(n) AS BIGINT) AS n FROM wrong GROUP BY ALL) SELECT * FROM t ORDER BY n DESC, "true", pred LIMIT 15""")
def e8_top_confusions(spark, sf):
    return ev.top_confusions(judged(spark, sf).where("label IS NOT NULL"), 15)


@query("e8_confusions_by_source", J + WRONG + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, "true", pred) AS rank FROM wrong) WHERE rank <= 8""")
def e8_confusions_by_source(spark, sf):
    return ev.top_confusions(judged(spark, sf).where("label IS NOT NULL"), 8, ["source"])


MATCHED = """, matched AS (SELECT *, CASE WHEN txn_key % 5 <> 0 THEN raw END AS entry_id,
  CASE WHEN txn_key % 5 <> 0 AND txn_key % 7 <> 0 THEN category END AS mapped_category,
  CASE txn_key % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'rerank' END AS strategy FROM judged)"""


def matched(spark, sf):
    key = F.col("txn_key")
    return (
        judged(spark, sf)
        .withColumn("entry_id", F.when(key % 5 != 0, F.col("raw")))
        .withColumn("mapped_category", F.when((key % 5 != 0) & (key % 7 != 0), F.col("category")))
        .withColumn("strategy", F.when(key % 3 == 0, "exact").when(key % 3 == 1, "rerank"))
    )


@query("e9_coverage", J + MATCHED + """
, b AS (SELECT CASE WHEN entry_id IS NULL THEN 'miss' WHEN mapped_category IS NULL THEN 'no_category'
  WHEN mapped_category = label THEN 'correct' ELSE 'wrong' END AS bucket FROM matched)
SELECT count(*) AS total, count_if(bucket = 'correct') AS correct, count_if(bucket = 'wrong') AS wrong, count_if(bucket = 'no_category') AS no_category,
  count_if(bucket = 'miss') AS miss, round(count_if(bucket IN ('correct', 'wrong')) / count(*), 6) AS ceiling_mapped,
  round(1 - count_if(bucket = 'miss') / count(*), 6) AS ceiling_all FROM b""")
def e9_coverage(spark, sf):
    return rounded(ev.coverage(matched(spark, sf)), "ceiling_mapped", "ceiling_all")


@query("e11_strategy_quality", J + MATCHED + """
SELECT strategy, count(*) AS n, round(avg(confidence), 6) AS mean_similarity, min(confidence) AS min_similarity,
  count(mapped_category) AS mapped, count_if(mapped_category = label) AS correct,
  round(coalesce(count_if(mapped_category = label) / nullif(count(mapped_category), 0), 0), 6) AS accuracy
FROM matched WHERE strategy IS NOT NULL GROUP BY strategy""")
def e11_strategy_quality(spark, sf):
    rows = matched(spark, sf).withColumn("similarity", F.col("confidence"))
    return rounded(ev.strategy_quality(rows), "mean_similarity", "accuracy")


@query("e12_sensitivity", J + """
SELECT changed, count(*) AS n FROM (SELECT DISTINCT txn_key, raw, amount, category <> CASE WHEN txn_key % 2 = 0 THEN category ELSE 'Income' END AS changed FROM judged) GROUP BY changed""")
def e12_sensitivity(spark, sf):
    rows = judged(spark, sf).select("txn_key", "raw", "amount", "category", "confidence").distinct().withColumn(
        "key", F.concat_ws("|", "txn_key", "raw", F.col("amount").cast("string"))
    )
    after = rows.withColumn("category", F.when(F.col("txn_key") % 2 == 0, F.col("category")).otherwise("Income"))
    return ev.sensitivity(rows, after, "key").groupBy("changed").agg(F.count("*").alias("n"))


@query("e13_mismatches", J + WEIGHTED + f"""
SELECT raw, category, label, occurrence_count FROM w WHERE NOT {OK}""")
def e13_mismatches(spark, sf):
    return ev.mismatches(unique_rows(spark, sf), "occurrence_count", "raw").select("raw", "category", "label", "occurrence_count")


MODELS = """, models AS (SELECT 'plain' AS model, category, label, source, confidence FROM judged UNION ALL
  SELECT 'shifted', CASE WHEN txn_key % 4 = 0 THEN label ELSE category END, label, source, confidence FROM judged)"""


def models(spark, sf):
    """Two models' answers to the same rows, which are judged and written once."""
    rows = cut_lineage(judged(spark, sf).select("txn_key", "category", "label", "source", "confidence"))
    shifted = rows.withColumn("category", F.when(F.col("txn_key") % 4 == 0, F.col("label")).otherwise(F.col("category")))
    return rows.withColumn("model", F.lit("plain")).unionByName(shifted.withColumn("model", F.lit("shifted")))


@query("e14_models", J + MODELS + f"""
SELECT model, count(*) AS n, round(avg(CAST({OK} AS INT)), 6) AS accuracy, count_if(source = 'sgd') AS model_n,
  round(count_if(source = 'sgd' AND {OK}) / count_if(source = 'sgd'), 6) AS model_accuracy, round(avg(confidence), 6) AS mean_confidence
FROM models GROUP BY model""")
def e14_models(spark, sf):
    return rounded(ev.compare_models(models(spark, sf)), "accuracy", "model_accuracy", "mean_confidence")


@query("e14_category_by_model", J + MODELS + f"""
SELECT label, round(avg(CAST({OK} AS INT)) FILTER (model = 'plain'), 6) AS plain, round(avg(CAST({OK} AS INT)) FILTER (model = 'shifted'), 6) AS shifted
FROM models GROUP BY label""")
def e14_category_by_model(spark, sf):
    return rounded(ev.category_by_model(models(spark, sf), ["plain", "shifted"]), "plain", "shifted")


@query("e15_discordant", J + f"""
, p AS (SELECT {OK} AS a, (CASE WHEN txn_key % 4 = 0 THEN label ELSE 'Income' END) IS NOT DISTINCT FROM label AS b FROM judged)
SELECT count_if(a AND NOT b) AS only_first, count_if(NOT a AND b) AS only_second FROM p""")
def e15_discordant(spark, sf):
    rows = judged(spark, sf).withColumn("other", F.when(F.col("txn_key") % 4 == 0, F.col("label")).otherwise("Income"))
    return ev.discordant(rows, "category", "other")


@query("e16_agreement", """
SELECT count(*) AS n, count_if(quality = guess) AS agreed, round(avg(CAST(quality = guess AS INT)), 6) AS rate FROM labels l
JOIN (SELECT doc_id, CAST(n_chars > 500 AS INT) AS guess FROM documents) d ON l.doc_id = d.doc_id""")
def e16_agreement(spark, sf):
    guess = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("guess"))
    return rounded(ev.agreement(table(spark, sf, "labels"), guess, "doc_id", "quality", "guess"), "rate")


@query("e17_exact_duplicates", """
SELECT md5(text) AS text_key, count(*) AS occurrence_count, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text""")
def e17_exact_duplicates(spark, sf):
    unique = ev.exact_duplicates(table(spark, sf, "documents"), "text", "doc_id", ["doc_id", "lang"])
    return unique.select(F.md5("text").alias("text_key"), "occurrence_count", "doc_id", "lang")


@query("e17_duplicate_summary", """
SELECT count(*) AS total, count(DISTINCT text) AS "unique", round(count(*) / count(DISTINCT text), 6) AS ratio FROM documents""")
def e17_duplicate_summary(spark, sf):
    unique = ev.exact_duplicates(table(spark, sf, "documents"), "text", "doc_id", [])
    return rounded(ev.duplicate_summary(unique), "ratio")


@query("e18_by_cleaned", q.with_(q.TXN, q.CLEANED) + """
, u AS (SELECT t.raw, any_value(r.cleaned) AS cleaned, count(*) AS occurrence_count FROM txn t JOIN raw_clean r ON t.raw = r.raw GROUP BY t.raw)
SELECT cleaned, count(*) AS variants, CAST(sum(occurrence_count) AS BIGINT) AS occurrence_count, min(raw) AS raw_example FROM u GROUP BY cleaned""")
def e18_by_cleaned(spark, sf):
    unique = ev.exact_duplicates(txn(spark, sf), "raw", "txn_key", [])
    return ev.by_cleaned(with_clean(unique, "raw"), "cleaned", "raw", "raw")


@query("e19_majority_label", J + """
, c AS (SELECT cleaned, category, count(*) AS n, min(txn_key) AS seen FROM judged GROUP BY ALL)
SELECT cleaned, category, n FROM (SELECT *, row_number() OVER (PARTITION BY cleaned ORDER BY n DESC, seen) AS r FROM c) WHERE r = 1""")
def e19_majority_label(spark, sf):
    return ev.majority_label(judged(spark, sf), "cleaned", "category", "txn_key")


WORDS = """
words AS (SELECT doc_id % 4 = 0 AS test, lang, unnest(string_split_regex(upper(replace(trim(text), 'ß', 'ss')), '\\s+')) AS word FROM documents),
kept AS (SELECT * FROM words WHERE word <> '')"""


def two_sets(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0")


@query("e20_vocabulary", q.with_(WORDS) + """
, v AS (SELECT word, bool_or(NOT test) AS a, bool_or(test) AS b FROM kept GROUP BY word)
SELECT count_if(a) AS train_words, count_if(b) AS test_words, count_if(a AND b) AS shared_words,
  round(1 - count_if(a AND b) / count_if(b), 6) AS unseen_share FROM v""")
def e20_vocabulary(spark, sf):
    return rounded(ev.vocabulary_overlap(*two_sets(spark, sf), "text"), "unseen_share")


@query("e21_template_inflation", q.with_(q.TXN, q.CLEANED) + """
, t AS (SELECT t.raw, r.cleaned, string_split(r.cleaned, ' ')[1] AS base FROM txn t JOIN raw_clean r ON t.raw = r.raw)
SELECT count(*) AS rows, count(DISTINCT raw) AS raw_texts, count(DISTINCT cleaned) AS cleaned_texts, count(DISTINCT base) AS base_names,
  round(count(*) / count(DISTINCT base), 6) AS variants_per_base FROM t""")
def e21_template_inflation(spark, sf):
    rows = with_clean(txn(spark, sf).select("raw"), "raw").withColumn("base", F.split("cleaned", " ")[0])
    return rounded(ev.template_inflation(rows, "raw", "cleaned", "base"), "variants_per_base")


@query("e22_class_shift", """
WITH a AS (SELECT lang, count(*) / (SELECT count(*) FROM documents WHERE doc_id % 4 <> 0) AS train_share FROM documents WHERE doc_id % 4 <> 0 GROUP BY lang),
b AS (SELECT lang, count(*) / (SELECT count(*) FROM documents WHERE doc_id % 4 = 0) AS test_share FROM documents WHERE doc_id % 4 = 0 GROUP BY lang)
SELECT coalesce(a.lang, b.lang) AS lang, round(coalesce(train_share, 0), 6) AS train_share, round(coalesce(test_share, 0), 6) AS test_share,
  round(coalesce(test_share, 0) - coalesce(train_share, 0), 6) AS shift FROM a FULL JOIN b ON a.lang = b.lang""")
def e22_class_shift(spark, sf):
    return rounded(ev.class_shift(*two_sets(spark, sf), "lang"), "train_share", "test_share", "shift")


@query("e23_word_purity", q.with_(WORDS) + """
, c AS (SELECT word, lang, count(*) AS n FROM kept GROUP BY ALL)
SELECT word, CAST(sum(n) AS BIGINT) AS n, count(*) AS categories, round(max(n) / sum(n), 6) AS purity FROM c GROUP BY word""")
def e23_word_purity(spark, sf):
    return rounded(ev.word_purity(table(spark, sf, "documents"), "text", "lang"), "purity")


@query("e24_calibration", J + f"""
SELECT {OK} AS correct, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM judged GROUP BY 1""")
def e24_calibration(spark, sf):
    return rounded(ev.calibration(judged(spark, sf)), "mean_confidence")


@query("e24_threshold_sweep", J + f"""
, t(threshold) AS (VALUES (0.5::DOUBLE), (0.6), (0.7), (0.8), (0.9), (0.95))
SELECT threshold, count_if(confidence >= threshold) AS kept, count_if(confidence >= threshold AND {OK}) AS correct,
  round(coalesce(count_if(confidence >= threshold AND {OK}) / nullif(count_if(confidence >= threshold), 0), 0), 6) AS accuracy
FROM judged, t GROUP BY threshold""")
def e24_threshold_sweep(spark, sf):
    return rounded(ev.threshold_sweep(judged(spark, sf)), "accuracy")


@query("e25_throughput")
def e25_throughput(spark, sf):
    report = ev.timed(judged(spark, sf).select("cleaned", "category", "confidence", "source"))
    return spark.createDataFrame([tuple(map(float, report.values()))], "rows double, seconds double, rows_per_second double")
