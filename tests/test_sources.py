"""Transaction CSV, sinks, run registry, rule files, and the stream against the batch cascade."""

import json

from pyspark.sql import functions as F

from spendlens.functions.rules import Rule, match_rules, read_rules, rule_table
from spendlens.operators.kb_build import alias_table
from spendlens.plans.classify import classify
from spendlens.plans.search import index_knowledge
from spendlens.sources.knowledge import read_kb_json
from spendlens.sources.results import register_run, stamped, write_rows
from spendlens.sources.transactions import TRANSACTION_SCHEMA, read_transactions
from spendlens.streaming.jobs import classify_stream, decisive_names


def test_statement_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "date,description,amount,type,source_file,account_type\n"
        '2024-01-02,"COFFEE, ""BIG"" CUP",-3.50,debit,a.pdf,chequing\n'
        '2024-01-03,"TWO\nLINES",10,credit,a.pdf,card\n'
        "2024-01-04,,x,debit,b.pdf,card\n"
    )
    rows = read_transactions(spark, str(path)).collect()
    assert [r.description for r in rows] == ['COFFEE, "BIG" CUP', "TWO\nLINES", None]
    assert [r.amount for r in rows] == [-3.5, 10.0, None] and rows[0].account_type == "chequing"
    assert read_transactions(spark, str(path)).columns == [f.split()[0] for f in TRANSACTION_SCHEMA.split(", ")]


def test_sinks_and_registry(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c', ["x", "y"]), (2, None, [])], "i int, text string, labels array<string>")
    marked = stamped(rows, "v7")
    for form in ("csv", "parquet"):
        for _ in range(2):  # a second write replaces the first
            write_rows(marked, str(tmp_path / form), form)
    csv = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').orderBy("i").collect()
    assert [(r.text, json.loads(r.labels), r.model_version) for r in csv] == [('a "b", c', ["x", "y"], "v7"), (None, [], "v7")]
    assert spark.read.parquet(str(tmp_path / "parquet")).orderBy("i").first().labels == ["x", "y"]
    for n in (1, 2):
        register_run(spark, str(tmp_path / "runs"), "sgd", f"v{n}", {"accuracy": n / 4}, {"c": n}, 100 * n, "note")
    runs = spark.read.parquet(str(tmp_path / "runs")).orderBy("version").collect()
    assert [(r.version, json.loads(r.metrics)["accuracy"], r.train_rows) for r in runs] == [("v1", 0.25, 100), ("v2", 0.5, 200)]
    assert all(r.registered_at is not None for r in runs)


def test_rule_files_and_exact_rules(spark, tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text(
        "rules:\n"
        "  - {pattern: blue shop, category: Whole, type: exact, priority: 90}\n"
        "  - {pattern: shop, category: Part}\n"
        "  - {pattern: '^RED \\d+$', category: Pattern, type: regex, priority: 60}\n"
        "  - {pattern: RED, category: Late, priority: 60}\n"
    )
    rules = read_rules(path)
    assert rules[0] == Rule("blue shop", "Whole", "exact", 90) and rules[1] == Rule("shop", "Part", "contains", 50)
    rows = spark.createDataFrame([("BLUE SHOP",), ("BLUE SHOP 2",), ("RED 12",), ("RED X",), ("NONE",)], "cleaned string")
    got = [r.c for r in rows.select(match_rules(F.col("cleaned"), rules)["category"].alias("c")).collect()]
    assert got == ["Whole", "Part", "Pattern", "Late", None]
    listed = rule_table(spark, rules).orderBy("idx").collect()
    assert [(r.idx, r.type, r.priority) for r in listed] == [(0, "exact", 90), (1, "contains", 50), (2, "regex", 60), (3, "contains", 60)]
    (tmp_path / "empty.yaml").write_text("")
    assert read_rules(tmp_path / "empty.yaml") == []


def test_stream_and_batch_agree_on_a_knowledge_base(spark, tmp_path):
    records = [
        {"canonical_name": "NORTHWIND CAFE", "aliases": ["NORTHWIND CAFE", "NORTHWIND"], "mapped_category": "Food & Dining", "mapping_confidence": 0.95},
        {"canonical_name": "PINE BOOKS", "aliases": ["PINE BOOKS", "PINE"], "mapped_category": "Shopping & Retail", "mapping_confidence": 0.4},
        {"canonical_name": "LAKE", "aliases": ["LAKE", "SHARED"], "mapped_category": "Income", "mapping_confidence": 0.9},
        {"canonical_name": "HILL", "aliases": ["HILL", "SHARED", "AB"], "mapped_category": "Income", "mapping_confidence": 0.9},
        {"canonical_name": "BARE", "aliases": ["BARE"], "mapping_confidence": 0.9},
    ]
    path = tmp_path / "kb.json"
    path.write_text(json.dumps(records))
    entries = read_kb_json(spark, str(path))
    kb = index_knowledge(entries, alias_table(entries), lexical=None)
    texts = ["NORTHWIND CAFE", "Northwind GAS W12", "PINE", "PINE GAS W9", "LAKE", "AB", "BARE", "UNKNOWN", "", "Payroll Deposit X", "HILL PHARMACY"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, description string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = classify_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), names=decisive_names(kb))
    writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    columns = ["i", "cleaned", "category", "confidence", "source", "flagged_for_review"]
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*columns).orderBy("i").collect()]
    want = [tuple(r) for r in classify(rows, kb=kb).select(*columns).orderBy("i").collect()]
    assert got == want and len([w for w in want if w[4] == "knowledge_base"]) >= 3
