"""Label collection: batches out, responses in, corrections and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.routing import is_category
from spendlens.functions.rows import exploded, settled
from spendlens.operators.ranking import hashed_rank
from spendlens.options import DEFAULTS, Options
from spendlens.session import cut_lineage, spread

NOISE_LINES = "DeprecationWarning|node --trace|Loaded cached"
PAIRS = "array<struct<description:string,category:string>>"


def label_batches(df: DataFrame, text: str, size: int = 30, template: str = "{transactions}") -> DataFrame:
    """Distinct texts in numbered groups of `size`, each with its prompt.

    Texts are numbered in the order of their digest without a global sort.
    """
    distinct = df.select(text).distinct().withColumn("_digest", F.md5(text))
    ranked = hashed_rank(distinct, [], "_digest", "_rank").withColumn(
        "batch", F.floor((F.col("_rank") - 1) / size) + 1
    )
    quoted = F.transform(
        F.array_sort(F.collect_list(F.struct("_rank", text))),
        lambda s: F.concat(F.lit('- "'), s[text], F.lit('"')),
    )
    before, after = template.split("{transactions}")
    return ranked.groupBy("batch").agg(
        F.count("*").alias("n"), F.concat(F.lit(before), F.concat_ws("\n", quoted), F.lit(after)).alias("prompt")
    )


def without_fence(plain: Column) -> Column:
    """Response text without code fences."""
    fence = F.when(plain.contains("```json"), F.lit("```json")).otherwise(F.lit("```"))
    behind = F.substring(plain, F.position(fence, plain) + F.length(fence), F.length(plain))
    fenced = F.trim(F.substring_index(behind, "```", 1))
    return F.when(plain.contains("```"), fenced).otherwise(plain)


def repaired(text: Column) -> Column:
    """An array cut off in the middle, closed behind its last whole object."""
    cut = F.regexp_extract(text, r"(?s)^(.*\})", 1)
    closed = F.concat(F.regexp_replace(cut, r"[\s,]+$", ""), F.lit("\n]"))
    return F.when(cut != "", closed)


def parse_responses(df: DataFrame, response: str) -> DataFrame:
    """One row per labelled description; none for bad input.

    Only known categories count; a description given twice keeps its last one.
    Each step is a column of its own, so it runs once per response: inside one
    expression a step runs once for every place, and every array element, that
    names it.
    """
    keep = [c for c in df.columns if c != response]
    lines = F.filter(F.split(F.coalesce(F.col(response), F.lit("")), "\n"), lambda x: ~x.rlike(NOISE_LINES))
    rows = spread(df).withColumn("_plain", F.trim(F.concat_ws("\n", lines)))
    rows = settled(rows, keep, _text=without_fence(F.col("_plain")))
    rows = settled(rows, [*keep, "_text"], _whole=F.json_array_length("_text").isNotNull())
    broken = ~F.col("_whole") & F.get_json_object("_text", "$").isNull()
    rows = settled(rows, [*keep, "_text", "_whole"], _mended=F.when(broken, repaired(F.col("_text"))))
    json = F.when(F.col("_whole"), F.col("_text")).when(F.json_array_length("_mended").isNotNull(), F.col("_mended"))
    parsed = F.coalesce(F.from_json(json, PAIRS), F.array().cast(PAIRS))
    valid = F.filter(parsed, lambda p: p["description"].isNotNull() & is_category(p["category"]))
    rows = settled(rows, keep, _valid=valid)
    last = F.filter(
        "_valid",
        lambda p, i: ~F.exists(
            F.slice("_valid", i + 2, F.size("_valid")), lambda q: q["description"] == p["description"]
        ),
    )
    return exploded(rows, keep, last, "p").select(*keep, "p.*")


def attach_labels(df: DataFrame, labels: DataFrame, key: str, out: str) -> DataFrame:
    """Label per key joined back to the rows; null when there is none."""
    side = labels.select(F.col("description").alias("_key"), F.col("category").alias(out))
    return df.join(side, F.col(key) == F.col("_key"), "left").drop("_key")


def latest_corrections(log: DataFrame, key: str = "description", order: list[str] | None = None) -> DataFrame:
    """Last correction per description: (key, predicted_category, correct_category)."""
    last = F.max_by(
        F.struct("predicted_category", "correct_category"), F.struct(*(order or ["ts"]))
    )
    return log.groupBy(key).agg(last.alias("m"), F.count("*").alias("corrections")).select(key, "m.*", "corrections")


def apply_corrections(df: DataFrame, latest: DataFrame, key: str = "description") -> DataFrame:
    """Predictions with corrected categories; `corrected` marks the changed rows."""
    side = latest.select(F.col(key).alias("_key"), F.col("correct_category").alias("_fixed"))
    joined = df.join(side, F.col(key) == F.col("_key"), "left")
    return joined.select(
        *[c for c in df.columns if c != "category"],
        F.coalesce("_fixed", "category").alias("category"),
        (F.col("_fixed").isNotNull() & ~F.col("_fixed").eqNullSafe(F.col("category"))).alias("corrected"),
    )


def override_merchants(df: DataFrame, overrides: DataFrame, merchant: str) -> DataFrame:
    """One category for all rows of a merchant (overrides: merchant, category)."""
    side = overrides.select(F.col("merchant").alias("_key"), F.col("category").alias("_fixed"))
    joined = df.join(side, F.col(merchant) == F.col("_key"), "left")
    return joined.select(
        *[c for c in df.columns if c != "category"], F.coalesce("_fixed", "category").alias("category")
    )


def disagreement(log: DataFrame, period: Column) -> DataFrame:
    """Share of corrections that changed the category, by category and period."""
    changed = ~F.col("predicted_category").eqNullSafe(F.col("correct_category"))
    return log.groupBy(period.alias("period"), F.col("predicted_category").alias("category")).agg(
        F.count("*").alias("n"), F.avg(changed.cast("double")).alias("rate")
    )


def review_queue(
    df: DataFrame,
    known: DataFrame,
    name: str = "cleaned",
    rule_category: str | None = None,
    options: Options = DEFAULTS,
) -> DataFrame:
    """Flagged rows in the order to look at them.

    New merchants (not in known.name) and rows where a rule and the model
    disagree come first, then those nearest to the threshold. The queue is
    written out before it is ordered, as the sort reads its input twice.
    """
    flagged = df.where("flagged_for_review")
    side = known.select(F.col("name").alias("_known")).where("_known IS NOT NULL").distinct()
    clash = F.lit(False)
    if rule_category:
        clash = F.coalesce(F.col(rule_category) != F.col("category"), F.lit(False))
    margin = F.round(F.abs(F.coalesce("confidence", F.lit(0.0)) - options.review_threshold), 6)
    met = flagged.join(side, F.col(name) == F.col("_known"), "left").withColumn("is_new", F.col("_known").isNull())
    queue = cut_lineage(met.drop("_known").withColumn("disagrees", clash).withColumn("margin", margin))
    return queue.orderBy(
        F.desc(F.col("is_new") | F.col("disagrees")), F.asc("margin"), F.asc(name)
    )
