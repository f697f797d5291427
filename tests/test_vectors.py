"""Vectors kept by text digest and encoder version."""

import os

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from spendlens.functions.terms import char_grams
from spendlens.operators.dense import best_in_block, nearest
from spendlens.operators.embedding import hashed_vectors, stored_vectors


class Noisy:
    """Never gives the same vector twice, and notes each text that it encodes."""

    def __init__(self, log, version="n1"):
        self.log, self.version = log, version

    def encode(self, texts):
        with open(self.log, "a") as log:
            log.writelines(f"{t}\n" for t in texts)
        return np.frombuffer(os.urandom(4 * len(texts)), dtype=np.uint8).reshape(len(texts), 4).astype(np.float32) + 1


def test_each_text_is_encoded_once(spark, tmp_path):
    root, log = str(tmp_path / "kept"), tmp_path / "log"
    rows = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")

    def vectors(encoder, *texts):
        return {r.query_id: tuple(r.vector) for r in stored_vectors(rows(*texts), "text", root, encoder).collect()}

    first = vectors(Noisy(log), "a", "b", "a", "", None)
    assert sorted(log.read_text().split("\n")[:-1]) == ["", "a", "b"]
    assert first[0] == first[2] and first[3] == first[4] and len(first) == 5
    again = vectors(Noisy(log), "b", "c", "a")
    assert sorted(log.read_text().split("\n")[:-1]) == ["", "a", "b", "c"]
    assert again[0] == first[1] and again[2] == first[0]
    assert vectors(Noisy(log), "a", "c") == {0: first[0], 1: again[1]}
    assert len(log.read_text().split("\n")[:-1]) == 4
    other = vectors(Noisy(log, "n2"), "a")
    assert len(log.read_text().split("\n")[:-1]) == 5 and other[0] != first[0]


def test_a_noisy_encoder_answers_all_queries(spark, tmp_path):
    root, encoder = str(tmp_path / "kept"), Noisy(tmp_path / "log")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "query_id int, text string")
    vectors = stored_vectors(texts, "text", root, encoder).select("query_id", "vector")
    corpus = vectors.selectExpr("query_id AS entry_id", "vector")
    found = nearest(vectors, corpus, 1).collect()
    assert len(found) == 40 and all(r.similarity == 1.0 for r in found)


def test_a_floor_keeps_what_reaches_it_and_no_more():
    rng = np.random.default_rng(4)
    corpus = pd.DataFrame({"entry_id": rng.permutation(90), "vector": list(rng.integers(-2, 3, (90, 3)).astype(np.float32))})
    queries = pd.DataFrame({"vkey": [f"q{i:02}" for i in range(40)], "vector": list(rng.integers(-2, 3, (40, 3)).astype(np.float32))})
    scores = np.round(np.clip(unit(queries) @ unit(corpus).T, 0.0, 1.0), 6)
    floor = np.sort(scores, axis=1)[:, -5]
    found = best_in_block(9, queries.assign(floor=floor), corpus)
    for i, key in enumerate(queries["vkey"]):
        ranked = sorted(zip(-scores[i], corpus["entry_id"]))[:9]
        want = [(e, -s) for s, e in ranked if -s >= floor[i] - 1e-6 or floor[i] <= 0]
        got = found[found["qkey"] == key]
        assert list(zip(got["entry_id"], got["similarity"])) == want
    assert len(found) < 9 * 40


def unit(rows):
    matrix = np.stack(rows["vector"]).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def test_hashed_vectors_equal_those_of_the_ml_stages(spark):
    texts = [
        "Ab c", "", "  \t x\ny\x0b\x0cz\r ", "a" * 50 + " b", "the the cat", "é", "漢",
        "\U0001f600\U0001f600 straße İI éàü漢字漢字 \u00a0nbsp\u2003em \u0085nel ls\x1cfs", "\u0000 \u0001ab",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    grams = rows.withColumn("grams", char_grams(F.col("text"), 3, 5))
    counted = HashingTF(numFeatures=256, inputCol="grams", outputCol="tf").transform(grams)
    unit_counts = Normalizer(p=2.0, inputCol="tf", outputCol="unit").transform(counted)
    want = {r.id: r.v for r in unit_counts.select("id", vector_to_array("unit", "float32").alias("v")).collect()}
    made = hashed_vectors(rows, "text")
    assert made.columns == ["id", "text", "vector"]
    assert {r.id: r.vector for r in made.collect()} == want
    # Interpreted lambdas cut the grams before, one expression per character.
    assert "lambdafunction" not in made._jdf.queryExecution().optimizedPlan().toString()
