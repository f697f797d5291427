"""Long words, common terms, corrections of restarted streams, white space, and repeated grams."""

import math
from collections import Counter

from pyspark.sql import functions as F

from spendlens.functions.white import strip
from spendlens.operators.evaluate import exact_p
from spendlens.operators.lexical import sparse_top_k
from spendlens.operators.models import STEPS, damped
from spendlens.operators.statements import account_descriptions
from spendlens.operators.training import shrink_words
from spendlens.sources.tables import read_version
from spendlens.streaming.jobs import correction_sink


def test_long_words_keep_their_tail(spark):
    word = "XA" * 2000
    row = spark.range(1).select(shrink_words(F.lit(f"{word} AB"), 1).alias("t")).first()
    assert row["t"] == "X" * 2000 + " AB".replace("B", "B")


def test_common_terms_rank_by_unrounded_scores(spark):
    postings = [(d, "the", 1e-6 * (1 + d / 100)) for d in range(20)]
    asked = spark.createDataFrame([(1, "the", 1.0)], "query_id int, term string, qweight double")
    docs = spark.createDataFrame(postings, "doc_id int, term string, weight double")
    found = sparse_top_k(asked, docs, 20).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == list(range(19, -1, -1))


def test_corrections_of_a_restarted_stream(spark, tmp_path):
    schema = "description string, predicted_category string, correct_category string, ts long"
    root, source = f"file://{tmp_path}/table", str(tmp_path / "in")

    def deliver(rows, checkpoint):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        writer = correction_sink(stream, root).option("checkpointLocation", str(tmp_path / checkpoint))
        writer.trigger(availableNow=True).start().awaitTermination()
        return {r["description"]: r["correct_category"] for r in read_version(spark, root, "corrections").collect()}

    assert deliver([("a", "x", "one", 1), ("a", "x", "two", 2)], "first") == {"a": "two"}
    assert deliver([("b", "x", "one", 1)], "first") == {"a": "two", "b": "one"}
    assert deliver([("z", "x", "new", 1), ("a", "x", "old", 0)], "second") == {"a": "two", "b": "one", "z": "new"}


def test_white_space_at_the_ends(spark):
    row = spark.range(1).select(
        strip(F.lit("\t a b \r\n")).alias("s"),
        account_descriptions(F.lit(" Details of your account activity\r\n\tDate\r\n27 Dec\r\nShop \r\n12.50\r\nClosing Balance\r")).alias("d"),
    ).first()
    assert row["s"] == "a b" and row["d"] == ["Shop"]


def test_repeated_grams_are_damped(spark):
    grams = ["a"] * 7 + ["b"] + ["c"] * 2 + ["a"]
    row = spark.createDataFrame([(grams, ["x", "y"], [])], "g array<string>, once array<string>, none array<string>").select(
        damped(F.col("g")).alias("g"), damped(F.col("once")).alias("once"), damped(F.col("none")).alias("none")
    ).first()
    want = {g: round(STEPS * (1 + math.log(n))) for g, n in Counter(grams).items()}
    assert Counter(row["g"]) == want and row["once"] == ["x", "y"] and row["none"] == []


def test_paired_p_of_large_counts():
    exact = 2 * sum(math.comb(120, i) for i in range(51)) / 2**120
    assert abs(exact_p(50, 70) - exact) < 1e-12
    assert 0 < exact_p(500_300, 499_700) < 1 and exact_p(10**7, 0) == 0.0
