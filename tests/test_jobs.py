"""Statements, responses, models, and a few registered queries against their SQL."""

import pytest
from pyspark.sql import functions as F

from checks.catalog import ORACLES, QUERIES
from checks.compare import connect, difference
from spendlens.operators.evaluate import exact_p
from spendlens.operators.labelling import parse_responses
from spendlens.operators import models
from spendlens.operators.models import ExternalTextModel, LinearTextModel, train_text_model
from spendlens.operators.statements import account_descriptions, card_descriptions

SF = "/root/testdata/sf0.001"


def test_account_and_card_pages(spark):
    account = "x\nDetails of your account activity\nDate\n27 Dec\nVisa Debit purchase\n 4232 Shop \n12.50\nMisc\nClosing Balance\ny"
    card = "h\nACTIVITY DESCRIPTION\nAMOUNT ($)\nDATE\nDEC 08\nDEC 09 TIM HORTONS\n123456789012345678\n$4.20\nCONTACT US\nz"
    row = spark.range(1).select(
        account_descriptions(F.lit(account)).alias("a"), card_descriptions(F.lit(card)).alias("c"),
        account_descriptions(F.lit("nothing here")).alias("n"),
    ).first()
    assert row["a"] == ["Visa Debit purchase 4232 Shop", "Misc"]
    assert row["c"] == ["TIM HORTONS"]
    assert row["n"] == []


def test_responses(spark):
    one = '{"description": "A", "category": "Income"}'
    rows = [
        (1, f"[{one}]"), (2, f"```json\n[{one}]\n```"), (3, f"[{one}, {{\"description\": \"B"), (4, "no"), (5, one),
        (6, f'[{one}, {{"description": "A", "category": "Transportation"}}, {{"description": "C", "category": "x"}}]'),
    ]
    got = {(r["i"], r["description"], r["category"]) for r in parse_responses(spark.createDataFrame(rows, "i int, r string"), "r").collect()}
    assert got == {(1, "A", "Income"), (2, "A", "Income"), (3, "A", "Income"), (6, "A", "Transportation")}


class Length:
    def predict(self, texts):
        return [("Income", len(t) / 100) for t in texts]


def test_models(spark, tmp_path):
    rows = [(t, c) for c, texts in {
        "Food & Dining": ["TIM HORTONS", "STARBUCKS", "PIZZA PIZZA", "SUBWAY"],
        "Transportation": ["UBER TRIP", "PETRO-CANADA", "OC TRANSPO", "PRESTO"],
    }.items() for t in texts]
    df = spark.createDataFrame(rows, "cleaned string, category string")
    model = train_text_model(df, features=1 << 12, iterations=10)
    assert model.info()["n_features"] == 1 << 12
    first = {r["cleaned"]: (r["category"], r["confidence"]) for r in model.score(df, "cleaned").collect()}
    assert first["STARBUCKS"][0] == "Food & Dining" and all(0 <= p <= 1 for _, p in first.values())
    model.save(str(tmp_path / "m"))
    again = LinearTextModel.load(str(tmp_path / "m"))
    second = {r["cleaned"]: (r["category"], r["confidence"]) for r in again.score(df, "cleaned").collect()}
    assert all(first[t][0] == second[t][0] and abs(first[t][1] - second[t][1]) < 1e-6 for t in first)
    outside = ExternalTextModel(Length()).score(df, "cleaned").collect()
    assert {r["confidence"] for r in outside if r["cleaned"] == "SUBWAY"} == {0.06}


@pytest.mark.parametrize("kind", ["linear", "subword"])
def test_fit_reads_no_more_partitions_than_cores(spark, monkeypatch, kind):
    seen, fit = [], models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    df = spark.createDataFrame([(f"shop {i % 7}", ["Income", "Transportation"][i % 2]) for i in range(60)], "cleaned string, category string")
    model = train_text_model(df.repartition(30), kind=kind, features=1 << 8, iterations=2)
    assert len(seen) == 1 and seen[0] <= spark.sparkContext.defaultParallelism
    assert model.score(df, "cleaned").count() == 60


def test_exact_p():
    assert exact_p(0, 0) == 1.0
    assert abs(exact_p(39, 6) - 5.4e-7) < 1e-7


@pytest.mark.parametrize("name", ["n2_markers", "r2_r5_rule_hits", "b2_label_ties", "k9_descriptor_context", "e6_class_report", "l2_line_islands", "t1_stratified_split"])
def test_query_matches_sql(spark, name):
    found = QUERIES[name](spark, SF).toPandas()
    assert difference(found, connect(SF).execute(ORACLES[name]).df()) is None
