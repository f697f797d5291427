"""Accuracy, coverage and quality reports as metric tables."""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.fixed import CATEGORIES
from spendlens.functions.labels import map_labels
from spendlens.functions.names import strings
from spendlens.functions.routing import is_category
from spendlens.functions.rows import exploded
from spendlens.functions.tokens import tokenize
from spendlens.operators.ranking import top_n

MODEL_SOURCES = ["finetune", "finetune_metadata", "setfit", "fasttext", "sgd", "canine"]
THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


def matches(pred: str = "category", true: str = "label") -> Column:
    return F.col(pred).eqNullSafe(F.col(true))


def counted(pred: str = "category", true: str = "label") -> list[Column]:
    hit = matches(pred, true)
    return [
        F.count("*").alias("n"),
        F.count_if(hit).alias("correct"),
        F.avg(hit.cast("double")).alias("accuracy"),
    ]


def labelled_rows(df: DataFrame, true: str = "label") -> DataFrame:
    """Rows whose label is a known category."""
    return df.where(is_category(F.col(true)))


def accuracy(df: DataFrame, pred: str = "category", true: str = "label") -> DataFrame:
    return df.agg(*counted(pred, true))


def weighted_accuracy(df: DataFrame, weight: str, pred: str = "category", true: str = "label") -> DataFrame:
    hit = F.when(matches(pred, true), F.col(weight)).otherwise(0)
    return df.agg(
        F.sum(hit).alias("correct"),
        F.sum(weight).alias("total"),
        (F.sum(hit) / F.sum(weight)).alias("accuracy"),
    )


def breakdown(df: DataFrame, keys: list[str], pred: str = "category", true: str = "label") -> DataFrame:
    """Counts and accuracy by each key on its own, in one pass over pre-counted rows."""
    hit = matches(pred, true)
    small = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.count("*").alias("_n"), F.count_if(hit).alias("_hits")
    )
    rows = small.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(f"_{k}").alias("value")) for k in keys])).alias("d"),
        "_n",
        "_hits",
    )
    return rows.groupBy("d.dimension", "d.value").agg(
        F.sum("_n").alias("n"),
        F.sum("_hits").alias("correct"),
        (F.sum("_hits") / F.sum("_n")).alias("accuracy"),
    )


def model_only(df: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Rows answered by a model rather than by direction, rules or knowledge."""
    return df.where(F.col("source").isin(*(sources or MODEL_SOURCES)))


def flag_rates(df: DataFrame, threshold: float = 0.70, flag: str = "flagged_for_review") -> DataFrame:
    return df.agg(
        F.count("*").alias("n"),
        F.avg(F.col(flag).cast("double")).alias("flag_rate"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg((F.col("confidence") < threshold).cast("double")).alias("below_threshold"),
    )


def pair_counts(df: DataFrame, pred: str = "category", true: str = "label") -> DataFrame:
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, pred: str = "category", true: str = "label") -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted averages."""
    counts = pair_counts(df, pred, true)
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.where(F.col("label").isNotNull()).groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.col("hits") / F.nullif("predicted", F.lit(0)), zero)
    recall = F.coalesce(F.col("hits") / F.nullif("support", F.lit(0)), zero)
    ratios = sums.select("label", "support", precision.alias("precision"), recall.alias("recall"))
    f1 = F.coalesce(
        2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), zero), zero
    )
    per_class = ratios.withColumn("f1", f1)

    def average(name: str, weight: Column) -> DataFrame:
        return per_class.agg(
            F.lit(name).alias("label"),
            *[(F.sum(F.col(m) * weight) / F.sum(weight)).alias(m) for m in ("precision", "recall", "f1")],
            F.sum("support").alias("support"),
        )

    return per_class.unionByName(average("macro avg", F.lit(1.0))).unionByName(
        average("weighted avg", F.col("support"))
    )


def confusion_matrix(df: DataFrame, labels: list[str] | None = None, pred: str = "category", true: str = "label") -> DataFrame:
    """One row per true label, one column per predicted label, zeros filled."""
    labels = labels or CATEGORIES
    return pair_counts(df, pred, true).groupBy("true").pivot("pred", labels).agg(F.sum("n")).na.fill(0, labels)


def diagonal(df: DataFrame, pred: str = "category", true: str = "label") -> DataFrame:
    counts = pair_counts(df, pred, true)
    return counts.agg(
        F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("correct"), F.sum("n").alias("total")
    )


def top_confusions(df: DataFrame, n: int, by: list[str] | None = None, pred: str = "category", true: str = "label") -> DataFrame:
    """Most frequent (true, pred) errors, overall or per key."""
    wrong = df.where(~matches(pred, true))
    keys = by or []
    counts = wrong.groupBy(*keys, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc("true"), F.asc("pred")]
    if keys:
        return top_n(counts, keys, order, n)
    return counts.orderBy(*order).limit(n)


def coverage(df: DataFrame, matched: str = "entry_id", kb: str = "mapped_category", true: str = "label") -> DataFrame:
    """How the knowledge base met each labelled text, and the two ceilings."""
    bucket = (
        F.when(F.col(matched).isNull(), "miss")
        .when(F.col(kb).isNull(), "no_category")
        .when(F.col(kb) == F.col(true), "correct")
        .otherwise("wrong")
    )
    n = lambda name: F.count_if(F.col("bucket") == name)
    return df.select(bucket.alias("bucket")).agg(
        F.count("*").alias("total"),
        *[n(b).alias(b) for b in ("correct", "wrong", "no_category", "miss")],
        ((n("correct") + n("wrong")) / F.count("*")).alias("ceiling_mapped"),
        (1 - n("miss") / F.count("*")).alias("ceiling_all"),
    )


def why_unmapped(df: DataFrame, labels: str = "raw_category_labels") -> DataFrame:
    """Matches without a category: those without labels and those with unmapped ones."""
    some = F.size(strings(F.col(labels))) > 0
    return df.agg(
        F.count("*").alias("n"), F.count_if(~some).alias("no_labels"), F.count_if(some).alias("unmapped_labels")
    )


def top_unmapped_labels(df: DataFrame, n: int, labels: str = "raw_category_labels") -> DataFrame:
    """Most frequent labels (first three per row) that map to nothing by themselves."""
    counts = exploded(df, [], F.slice(strings(F.col(labels)), 1, 3), "label").groupBy("label").agg(
        F.count("*").alias("n")
    )
    mapped = map_labels(counts.withColumn("one", F.array("label")), "one", "m")
    unmapped = mapped.where(F.col("m.category").isNull()).select("label", "n")
    return unmapped.orderBy(F.desc("n"), F.asc("label")).limit(n)


def strategy_quality(df: DataFrame, kb: str = "mapped_category", true: str = "label") -> DataFrame:
    mapped = F.col(kb).isNotNull()
    hit = mapped & (F.col(kb) == F.col(true))
    return df.where(F.col("strategy").isNotNull()).groupBy("strategy").agg(
        F.count("*").alias("n"),
        F.avg("similarity").alias("mean_similarity"),
        F.min("similarity").alias("min_similarity"),
        F.count_if(mapped).alias("mapped"),
        F.count_if(hit).alias("correct"),
        F.coalesce(F.count_if(hit) / F.nullif(F.count_if(mapped), F.lit(0)), F.lit(0.0)).alias("accuracy"),
    )


def sensitivity(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Predictions on raw and enriched text side by side, with whether they differ."""
    left = before.select(key, F.col("category").alias("raw_category"), F.col("confidence").alias("raw_confidence"))
    right = after.select(key, F.col("category").alias("rich_category"), F.col("confidence").alias("rich_confidence"))
    return left.join(right, key).withColumn("changed", ~F.col("raw_category").eqNullSafe(F.col("rich_category")))


def mismatches(df: DataFrame, weight: str, key: str, pred: str = "category", true: str = "label") -> DataFrame:
    """Wrong rows, most frequent first."""
    return df.where(~matches(pred, true)).orderBy(F.desc(weight), F.asc(key))


def compare_models(df: DataFrame, model: str = "model", pred: str = "category", true: str = "label") -> DataFrame:
    """Overall and model-only accuracy and mean confidence by model."""
    hit = matches(pred, true)
    answered = F.col("source").isin(*MODEL_SOURCES)
    return df.groupBy(model).agg(
        F.count("*").alias("n"),
        F.avg(hit.cast("double")).alias("accuracy"),
        F.count_if(answered).alias("model_n"),
        F.coalesce(F.count_if(answered & hit) / F.nullif(F.count_if(answered), F.lit(0)), F.lit(0.0)).alias("model_accuracy"),
        F.avg("confidence").alias("mean_confidence"),
    )


def category_by_model(df: DataFrame, models: list[str], model: str = "model", pred: str = "category", true: str = "label") -> DataFrame:
    """Accuracy per category, one column per model."""
    return df.groupBy(F.col(true).alias("label")).pivot(model, models).agg(F.avg(matches(pred, true).cast("double")))


def discordant(df: DataFrame, first: str, second: str, true: str = "label") -> DataFrame:
    """Rows only the first, and only the second, model got right."""
    a, b = matches(first, true), matches(second, true)
    return df.agg(F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"))


def exact_p(only_first: int, only_second: int) -> float:
    """Two-sided exact binomial p of the paired test, from the two counts.

    Terms are added from the largest down as shares of it, until they no longer
    count: about the square root of the counts, at any size.
    """
    n, i = only_first + only_second, min(only_first, only_second)
    if n == 0:
        return 1.0
    largest = lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * log(2)
    share = tail = 1.0
    while i and share > tail * 1e-18:
        share *= i / (n - i + 1)
        tail += share
        i -= 1
    return min(1.0, 2 * exp(largest + log(tail)))


def agreement(left: DataFrame, right: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Two label sources on the keys both hold."""
    both = left.select(key, first).join(right.select(key, second), key)
    same = F.col(first).eqNullSafe(F.col(second))
    return both.agg(F.count("*").alias("n"), F.count_if(same).alias("agreed"), F.avg(same.cast("double")).alias("rate"))


def exact_duplicates(df: DataFrame, text: str, order: str, keep: list[str]) -> DataFrame:
    """First row per text and how often the text occurs."""
    return df.groupBy(text).agg(
        F.count("*").alias("occurrence_count"), *[F.min_by(c, order).alias(c) for c in keep]
    )


def duplicate_summary(unique: DataFrame) -> DataFrame:
    return unique.agg(
        F.sum("occurrence_count").alias("total"),
        F.count("*").alias("unique"),
        (F.sum("occurrence_count") / F.count("*")).alias("ratio"),
    )


def by_cleaned(unique: DataFrame, cleaned: str, raw: str, order: str) -> DataFrame:
    """Raw variants of a cleaned text: their number, occurrences and first example."""
    return unique.groupBy(cleaned).agg(
        F.count("*").alias("variants"),
        F.sum("occurrence_count").alias("occurrence_count"),
        F.min_by(raw, order).alias("raw_example"),
    )


def majority_label(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """Most frequent label per key; ties to the label seen first."""
    counts = df.where(F.col(label).isNotNull() & (F.col(label) != "")).groupBy(key, label).agg(
        F.count("*").alias("n"), F.min(order).alias("seen")
    )
    return counts.groupBy(key).agg(
        F.max_by(F.struct(label, "n"), F.struct("n", -F.col("seen"))).alias("m")
    ).select(key, F.col(f"m.{label}").alias(label), "m.n")


def word_rows(df: DataFrame, text: str, *keep: str) -> DataFrame:
    return exploded(df, list(keep), tokenize(F.col(text)), "word")


def vocabulary_overlap(train: DataFrame, test: DataFrame, text: str) -> DataFrame:
    """Distinct words of both sides, shared words and the share of unseen test words."""
    known = word_rows(train, text).distinct().withColumn("in_train", F.lit(1)).withColumn("in_test", F.lit(0))
    asked = word_rows(test, text).distinct().withColumn("in_train", F.lit(0)).withColumn("in_test", F.lit(1))
    words = known.unionByName(asked).groupBy("word").agg(F.max("in_train").alias("a"), F.max("in_test").alias("b"))
    return words.agg(
        F.sum("a").alias("train_words"),
        F.sum("b").alias("test_words"),
        F.sum(F.col("a") * F.col("b")).alias("shared_words"),
        (1 - F.sum(F.col("a") * F.col("b")) / F.sum("b")).alias("unseen_share"),
    )


def template_inflation(df: DataFrame, raw: str, cleaned: str, base: str) -> DataFrame:
    """Rows against distinct raw, cleaned and base names, by distinct keys in turn."""
    triples = df.groupBy(raw, cleaned, base).agg(F.count("*").alias("n"))
    bases = triples.groupBy(base).agg(F.sum("n").alias("n"))
    total = bases.agg(F.sum("n").alias("rows"), F.count("*").alias("base_names"))
    cleaned_names = triples.select(cleaned).distinct().agg(F.count("*").alias("cleaned_texts"))
    raw_names = triples.select(raw).distinct().agg(F.count("*").alias("raw_texts"))
    return total.select(
        "rows",
        raw_names.scalar().alias("raw_texts"),
        cleaned_names.scalar().alias("cleaned_texts"),
        "base_names",
        (F.col("rows") / F.col("base_names")).alias("variants_per_base"),
    )


def class_shift(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Share of every class in two sets and the difference."""
    def share(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(label).agg(F.count("*").alias("n"))
        total = df.agg(F.count("*")).scalar()
        return counts.select(label, (F.col("n") / total).alias(name))

    joined = share(train, "train_share").join(share(test, "test_share"), label, "full_outer")
    return joined.na.fill(0.0, ["train_share", "test_share"]).withColumn(
        "shift", F.col("test_share") - F.col("train_share")
    )


def word_purity(df: DataFrame, text: str, label: str) -> DataFrame:
    """Per word: rows, number of categories and the share of its main one."""
    pairs = word_rows(df, text, label).groupBy("word", label).agg(F.count("*").alias("n"))
    return pairs.groupBy("word").agg(
        F.sum("n").alias("n"), F.count("*").alias("categories"), (F.max("n") / F.sum("n")).alias("purity")
    )


def calibration(df: DataFrame, pred: str = "category", true: str = "label") -> DataFrame:
    return df.groupBy(matches(pred, true).alias("correct")).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence")
    )


def threshold_sweep(df: DataFrame, thresholds: list[float] | None = None, pred: str = "category", true: str = "label") -> DataFrame:
    """Rows and accuracy at or above each confidence threshold, in one pass."""
    thresholds = thresholds or THRESHOLDS
    hit = matches(pred, true)
    one_row = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("threshold"),
                    F.count_if(F.col("confidence") >= t).alias("kept"),
                    F.count_if((F.col("confidence") >= t) & hit).alias("correct"),
                )
                for t in thresholds
            ]
        ).alias("rows")
    )
    return one_row.select(F.explode("rows").alias("r")).select(
        "r.*", F.coalesce(F.col("r.correct") / F.nullif("r.kept", F.lit(0)), F.lit(0.0)).alias("accuracy")
    )


def timed(df: DataFrame) -> dict[str, float]:
    """Rows, seconds and rows per second of evaluating every column once."""
    import time

    start = time.perf_counter()
    rows = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("h")).first()[0]
    seconds = time.perf_counter() - start
    return {"rows": rows, "seconds": seconds, "rows_per_second": rows / seconds if seconds else 0.0}
