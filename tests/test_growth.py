"""Work that must not grow faster than its input."""

import re

from pyspark.sql import functions as F

from spendlens import fixed
from spendlens.functions.tokens import analyze
from spendlens.functions.terms import words_and_pairs
from spendlens.llm import pii
from spendlens.operators.labelling import parse_responses, review_queue
from spendlens.operators.lexical import asked_terms, bm25_index, tfidf_index
from spendlens.operators.statements import any_pattern, descriptions
from spendlens.operators.training import pseudo_labels
from spendlens.plans.classify import Stage, classify


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_roles_stays_above_a_distinct(spark):
    rows = spark.createDataFrame([("SHOP GAS 12",), ("SHOP GAS 12",), ("SHOP",)], "text string")
    named = analyze(rows.distinct(), "text", "a").where(F.col("a.brand_query") != F.col("text"))
    plan = optimized(named)
    assert "RLIKE" in plan and "RLIKE" not in plan[plan.index("Aggregate") :]
    assert [r.text for r in named.collect()] == ["SHOP GAS 12"]


def test_lines_of_a_page_are_cut_once(spark):
    page = "Details of your account activity\n27 Dec\nShop\nnorth\n12.50\nRBC x MASTERCARD\nOther\nClosing Balance\nLate"
    rows = spark.createDataFrame([(page, "chequing"), ("Head\nACTIVITY DESCRIPTION\nDATE\nJAN 2 EXTRA", "mastercard"), (None, "chequing")], "text string, kind string")
    found = descriptions(rows, "text", "kind")
    assert sorted((r.pos, r.description) for r in found.collect()) == [(0, "EXTRA"), (0, "Shop north"), (1, "Other")]
    assert optimized(found).count("split(") <= 2  # a card page's and an account page's


def test_one_pattern_finds_what_each_finds():
    patterns = [*fixed.BOILERPLATE, "^a|b$", "x(y|z)"]
    lines = ["rbc my MASTERCARD", "x rbc my MASTERCARD", "12 OF 13", "12 OF 13 ", "cab", "a", "ca", "xz", "Abcdefghij12", "$", "a) b"]
    for line in lines:
        assert bool(re.search(any_pattern(patterns), line)) == any(re.search(p, line) for p in patterns), line


def test_a_response_is_parsed_once(spark):
    body = '[{"description": "a", "category": "Odd"}, {"description": "b", "category": "Income"}, {"description": "b", "category": "Transportation"}'
    texts = [body + "]", "Sure:\n```json\n" + body + "]\n```\nbye", body + ', {"description": "cut', "no idea", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, response string")
    found = parse_responses(rows, "response")
    assert sorted((r.id, r.description, r.category) for r in found.collect()) == [(i, "b", "Transportation") for i in range(3)]
    assert optimized(found).count("from_json(") == 1


def test_a_review_queue_reads_its_rows_once(spark):
    fields = "cleaned string, category string, confidence double, flagged_for_review boolean, rule string"
    rows = spark.createDataFrame(
        [("NEW", "A", 0.6, True, "A"), ("OLD", "A", 0.6, True, "B"), (None, "A", 0.5, True, "A"), ("OLD", "A", 0.9, False, "A")], fields
    )
    known = spark.createDataFrame([("OLD",), ("OLD",), (None,)], "name string")
    queue = review_queue(rows, known, "cleaned", "rule")
    assert [(r.cleaned, r.is_new, r.disagrees) for r in queue.collect()] == [("NEW", True, False), ("OLD", False, True), (None, True, False)]
    assert "LogicalRDD" not in optimized(queue)  # the sort reads what was written, not the rows once more


def test_postings_of_asked_terms_weigh_as_in_the_whole_index(spark):
    texts = [(1, "red bolt red nut"), (2, "red bolt"), (2, "blue bolt"), (3, "blue nut nut"), (4, None), (None, "red bolt")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    queries = spark.createDataFrame([("red bolt gone",)], "text string")
    asked = asked_terms(queries, words_and_pairs(F.col("text")))
    wanted = {r.term for r in asked.collect()}

    def held(postings, only=None):
        rows = postings.select("doc_id", "term", F.round("weight", 9).alias("weight")).collect()
        return sorted((str(r.doc_id), r.term, r.weight) for r in rows if only is None or r.term in only)

    whole, terms = tfidf_index(docs, "doc_id", "text")
    some, known = tfidf_index(docs, "doc_id", "text", asked)
    assert held(some) == held(whole, wanted) and held(some)
    assert {r.term for r in known.collect()} == wanted & {r.term for r in terms.collect()}
    some = held(bm25_index(docs, "doc_id", "text", asked))
    assert some == held(bm25_index(docs, "doc_id", "text"), wanted) and some


def test_personal_data_is_learned_from_all_documents(spark, monkeypatch):
    seen, whole = [], pii._with_candidates

    def counted(docs, text):
        seen.append(docs.count())
        return whole(docs.limit(0), text)

    monkeypatch.setattr(pii, "_with_candidates", counted)
    pii.learn(spark.range(20_500).select(F.concat(F.lit("x"), "id").alias("text")))
    assert seen == [20_500]


class Answer:
    def score(self, df, text):
        return df.withColumn("category", F.lit("Income")).withColumn("confidence", F.lit(0.5))


def test_a_cascade_cleans_each_row_once(spark):
    rows = spark.createDataFrame([(1, "SHOP ABC"), (2, "Payroll Deposit x"), (3, "SHOP ABC"), (4, None)], "id int, description string")
    found = classify(rows.withColumn("nothing", F.lit(None)), stages=[Stage("m", Answer())])
    assert "LogicalRDD" not in optimized(found)
    assert sorted((r.id, r.nothing, r.source) for r in found.collect()) == [(1, None, "m"), (2, None, "direction"), (3, None, "m"), (4, None, "m")]


def test_predictions_are_made_once_for_pseudo_labels(spark):
    rows = spark.createDataFrame([(i, "Income", 0.9 + i / 100) for i in range(10)], "id int, category string, confidence double")
    found = pseudo_labels(rows)
    assert "LogicalRDD" not in optimized(found)
    assert sorted(r.id for r in found.collect()) == [8, 9]


def test_rows_of_two_models_are_judged_once(spark, tmp_path):
    from checks.eval_queries import e14_models

    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string, l_shipdate date"
    spark.createDataFrame([(i, 1, 1, 1, 10.0 * i, "A", None) for i in range(12)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "red bolt", "PROMO")], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = e14_models(spark, str(tmp_path))
    assert "RLIKE" not in optimized(found)
    assert sorted((r.model, r.n) for r in found.collect()) == [("plain", 12), ("shifted", 12)]
