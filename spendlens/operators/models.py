"""Text and vector classifiers on Spark ML, and the hook for external models."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.fixed import CATEGORIES
from spendlens.functions.terms import char_grams, words_and_pairs
from spendlens.operators.dense import vector_key
from spendlens.operators.ranking import top_n

FEATURES = 100_000
STEPS = 4


class Predictor(Protocol):
    """Picklable; `predict` is called in tasks, so load heavy models lazily there."""

    def predict(self, texts: list[str]) -> list[tuple[str, float]]: ...


def linear_grams(text: Column) -> Column:
    """Features of the linear model: character 3- to 5-grams inside words."""
    return char_grams(text, 3, 5)


def subword_grams(text: Column) -> Column:
    """Features of the subword model: character 3- to 6-grams, words and word pairs."""
    return F.concat(char_grams(text, 3, 6), words_and_pairs(text))


GRAMS = {"linear": linear_grams, "subword": subword_grams}


def damped(grams: Column) -> Column:
    """Grams repeated so that counts grow as 1 + ln(count).

    Weights are in steps of 1/STEPS; unit-length scaling later removes the
    factor. Texts without a repeated gram, the usual case, stay as they are.
    """

    def weighted(sorted_grams: Column) -> Column:
        n = F.size(sorted_grams)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(sorted_grams, i) != F.get(sorted_grams, F.greatest(i - 1, F.lit(0)))),
        )
        return F.flatten(F.transform(F.array(starts), lambda at: F.flatten(F.transform(at, lambda i, j: F.array_repeat(
            F.get(sorted_grams, i),
            F.round(STEPS * (1.0 + F.log((F.coalesce(F.get(at, j + 1), n) - i).cast("double")))).cast("int"),
        )))))

    repeated = F.flatten(F.transform(F.array(F.sort_array(grams)), weighted))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), grams).otherwise(repeated)


class LinearTextModel:
    """A fitted gram -> TF-IDF -> logistic regression model."""

    def __init__(self, pipeline: PipelineModel, kind: str = "linear"):
        self.pipeline = pipeline
        self.kind = kind

    def score(self, df: DataFrame, text: str) -> DataFrame:
        """Adds category and confidence; ties go to the first label."""
        kept = [c for c in df.columns if c not in ("category", "confidence")]
        grams = df.select(*kept, damped(GRAMS[self.kind](F.col(text))).alias("_grams"))
        scored = self.pipeline.transform(grams)
        labels = F.array(*[F.lit(c) for c in CATEGORIES])
        return scored.select(
            *kept,
            F.get(labels, F.col("_prediction").cast("int")).alias("category"),
            F.array_max(vector_to_array("_probability")).alias("confidence"),
        )

    def info(self) -> dict:
        model = self.pipeline.stages[-1]
        return {"n_features": model.numFeatures, "classes": CATEGORIES[: model.numClasses]}

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/{self.kind}")

    @classmethod
    def load(cls, path: str, kind: str = "linear") -> LinearTextModel:
        return cls(PipelineModel.load(f"{path}/{kind}"), kind)


def train_text_model(
    df: DataFrame,
    text: str = "cleaned",
    label: str = "category",
    kind: str = "linear",
    features: int = FEATURES,
    iterations: int = 50,
    regularization: float = 1e-5,
) -> LinearTextModel:
    """Fit on rows weighted so that every class counts the same.

    Equal rows (text and label) are cut into grams and hashed once and counted as often as they come. Each step of the
    fit shuffles a gradient (classes x features) per partition, so the cached rows are read in no more partitions than
    there are cores.
    """
    rows = (
        df.where(F.col(label).isin(*CATEGORIES))
        .groupBy(F.col(text).alias("_text"), F.col(label).alias("_label"))
        .agg(F.count("*").alias("_times"))
        .persist()
    )
    sizes = rows.groupBy("_label").agg(F.sum("_times").alias("_n")).persist()
    total = sizes.agg(F.sum("_n")).scalar()
    weights = sizes.select("_label", (total / (sizes.agg(F.count("*")).scalar() * F.col("_n"))).alias("_weight"))
    indexer = StringIndexerModel.from_labels(CATEGORIES, "_label", "_index")
    grams = indexer.transform(rows.join(F.broadcast(weights), "_label")).select(
        damped(GRAMS[kind](F.col("_text"))).alias("_grams"), "_index", "_weight", "_times"
    )
    hashed = HashingTF(numFeatures=features, inputCol="_grams", outputCol="_tf")
    cores = df.sparkSession.sparkContext.defaultParallelism
    counts = hashed.transform(grams).drop("_grams").persist()
    every = counts.coalesce(cores).select("_tf", "_index", "_weight", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    pipeline = Pipeline(
        stages=[
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(p=2.0, inputCol="_tfidf", outputCol="_unit"),
            LogisticRegression(
                featuresCol="_unit",
                labelCol="_index",
                weightCol="_weight",
                predictionCol="_prediction",
                probabilityCol="_probability",
                rawPredictionCol="_raw",
                family="multinomial",
                maxIter=iterations,
                regParam=regularization,
            ),
        ]
    )
    fitted = pipeline.fit(every)
    for kept in (counts, sizes, rows):
        kept.unpersist()
    return LinearTextModel(PipelineModel([hashed, *fitted.stages]), kind)


class ExternalTextModel:
    """Any predictor, called on Arrow batches in the tasks."""

    def __init__(self, predictor: Predictor, batch: int = 256):
        self.predictor = predictor
        self.batch = batch

    def score(self, df: DataFrame, text: str) -> DataFrame:
        kept = [f for f in df.schema.fields if f.name not in ("category", "confidence")]
        schema = T.StructType(
            [*kept, T.StructField("category", T.StringType()), T.StructField("confidence", T.DoubleType())]
        )
        predictor, batch = self.predictor, self.batch

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in range(0, len(pdf), batch):
                    part = pdf.iloc[start : start + batch]
                    found = predictor.predict(part[text].tolist())
                    yield part.assign(category=[c for c, _ in found], confidence=[float(p) for _, p in found])

        return df.select(*[f.name for f in kept]).mapInPandas(run, schema)


CLASS_BLOCK = 256  # classes whose centroids are scored together


def class_centroids(df: DataFrame, vector: str = "vector", label: str = "label") -> DataFrame:
    """Mean vector per class by a combining aggregate."""
    return df.groupBy(label).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("centroid")
    )


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(left: Column, right: Column) -> Column:
    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.coalesce(dot(left, right) / F.nullif(norms, F.lit(0.0)), F.lit(0.0))


def nearest_centroid(df: DataFrame, centroids: DataFrame, vector: str = "vector", label: str = "label") -> DataFrame:
    """Class of the most similar centroid and that cosine; ties to the smaller label.

    Classes are cut into blocks by a hash, and each different vector meets each block once, so any number of classes
    is scored the same way. Without classes both columns are null.
    """
    blocks = max(1, -(-centroids.count() // CLASS_BLOCK))
    packed = centroids.groupBy(F.pmod(F.xxhash64(label), F.lit(blocks)).cast("int").alias("_block")).agg(
        F.collect_list(F.struct(F.col(label).alias("predicted"), "centroid")).alias("_classes")
    )
    keyed = df.withColumn("_key", F.coalesce(vector_key(F.col(vector)), F.lit("")))
    asked = keyed.groupBy("_key").agg(F.any_value(vector).alias("_vector"))
    met = asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "_block")
    scored = F.transform(
        "_classes",
        lambda c: F.struct((-F.round(cosine(F.col("_vector"), c["centroid"]), 6)).alias("apart"), c["predicted"].alias("predicted")),
    )
    best = met.groupBy("_key").agg(F.min(F.array_min(scored)).alias("_best"))
    return keyed.join(best, "_key", "left").select(
        *df.columns, F.col("_best.predicted").alias("predicted"), (-F.col("_best.apart")).alias("similarity")
    )


def neighbour_vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Majority label of each query's neighbours; ties to the closer neighbour.

    neighbours: query_id, entry_id, similarity, rank. labels: entry_id, label.
    """
    votes = (
        neighbours.join(labels, "entry_id")
        .groupBy("query_id", "label")
        .agg(F.count("*").alias("votes"), F.min("rank").alias("closest"))
    )
    return top_n(votes, ["query_id"], [F.desc("votes"), F.asc("closest")], 1).select(
        "query_id", F.col("label").alias("predicted"), "votes"
    )
