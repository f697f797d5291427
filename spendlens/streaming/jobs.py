"""Structured Streaming forms of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from spendlens.functions.cleaning import clean_text
from spendlens.functions.names import enriched_text
from spendlens.functions.routing import descriptor_override, direct_confidence, needs_review
from spendlens.functions.rules import Rule
from spendlens.functions.tokens import analyze
from spendlens.operators.models import LinearTextModel
from spendlens.options import DEFAULTS, Options
from spendlens.plans.classify import classify, quick_stages
from spendlens.plans.search import Knowledge
from spendlens.sources.tables import publish, read_version


def decisive_names(kb: Knowledge, options: Options = DEFAULTS) -> DataFrame:
    """Aliases of exactly one entry: (alias, kb_category), the category null where the entry may not name one.

    Such an alias still settles which entry is meant, so a brand is not looked up beside it.
    """
    unique = kb.aliases.groupBy("alias").agg(F.count_distinct("entry_id").alias("n"), F.min("entry_id").alias("entry_id"))
    strong = F.col("mapping_confidence") >= options.direct_mapping_confidence
    named = kb.entries.select("entry_id", F.when(strong, F.col("mapped_category")).alias("kb_category"))
    return unique.where("n = 1").join(named, "entry_id").select("alias", "kb_category")


def classify_stream(
    stream: DataFrame,
    text: str = "description",
    rules: list[Rule] | None = None,
    names: DataFrame | None = None,
    model: LinearTextModel | None = None,
    options: Options = DEFAULTS,
) -> DataFrame:
    """Direction, rules, exact and brand aliases, then the model, row by row.

    `names` (see decisive_names) is static: stream-static left joins keep no
    state. Brands of several words, aliases of several entries and similarity
    search need whole tables; use classify_batches for them.
    """
    rows = analyze(quick_stages(stream, text, rules, options), "cleaned", "_a")
    context = F.col("_a.descriptor_context")
    if names is not None:
        whole, brand = clean_text(F.col("cleaned")), clean_text(F.col("_a.brand_query"))
        differs = (F.col("_a.brand_query") != "") & (F.col("_a.brand_query") != whole)
        rows = rows.withColumn("_q0", whole).withColumn("_q1", F.when(differs, brand))
        for n in range(2):
            side = names.select(F.col("alias").alias(f"_k{n}"), F.col("kb_category").alias(f"_c{n}"))
            key = F.when(F.length(f"_q{n}") >= options.min_query_chars, F.col(f"_q{n}"))
            rows = rows.join(side, key == F.col(f"_k{n}"), "left")
        long_enough = F.length("_q0") >= options.min_query_chars
        kb = F.when(F.col("_k0").isNotNull(), F.col("_c0")).when(long_enough, F.col("_c1"))
        found = F.when(F.col("category").isNull(), kb)
        rows = rows.withColumn("_kb", found).drop(*[f"_{x}{n}" for x in "qkc" for n in range(2)])
        hit = F.col("_kb").isNotNull()
        rows = (
            rows.withColumn("source", F.when(hit, "knowledge_base").otherwise(F.col("source")))
            .withColumn("confidence", F.when(hit, direct_confidence(F.lit(1.0), options)).otherwise(F.col("confidence")))
            .withColumn(
                "category",
                F.when(hit, F.coalesce(descriptor_override(context, F.col("_kb")), F.col("_kb"))).otherwise(F.col("category")),
            )
            .drop("_kb")
        )
    if model is not None:
        none = F.lit(None).cast("string")
        rows = rows.withColumn(
            "model_text", enriched_text(F.col("cleaned"), none, none, none, F.lit(None).cast("array<string>"), context)
        )
        kept = rows.withColumnsRenamed({"category": "_category", "confidence": "_confidence"})
        scored = model.score(kept, "model_text")
        known = F.col("_category").isNotNull()
        rows = (
            scored.withColumn("category", F.when(known, F.col("_category")).otherwise(F.col("category")))
            .withColumn("confidence", F.when(known, F.col("_confidence")).otherwise(F.col("confidence")))
            .withColumn("source", F.coalesce("source", F.lit("sgd")))
            .drop("_category", "_confidence", "model_text")
        )
    trusted = F.col("source").isin("direction", "rules", "knowledge_base")
    flagged = (
        F.when(F.col("category").isNull() | (F.col("cleaned") == ""), F.lit(True))
        .when(trusted, F.lit(False))
        .otherwise(needs_review(F.col("confidence"), options))
    )
    return rows.withColumn("flagged_for_review", flagged).drop("_a")


def classify_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], **settings) -> DataStreamWriter:
    """The whole cascade on every micro-batch; `write(df, batch_id)` must be idempotent by id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write(classify(batch, **settings), batch_id)

    return stream.writeStream.foreachBatch(run)


def batch_folders(root: str) -> Callable[[DataFrame, int], None]:
    """A writer for classify_batches: a folder per batch, written anew when the batch is run again."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return write


def monitor(
    stream: DataFrame, ts: str = "ts", window: str = "1 day", watermark: str = "1 day", key: str = "source"
) -> DataFrame:
    """Counts, mean confidence and flag rate by key and tumbling window.

    `ts` may be a timestamp without zone; it is read in the session time zone.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark(ts, watermark)
    return (
        timed.groupBy(F.window(ts, window).alias("w"), key)
        .agg(
            F.count("*").alias("n"),
            F.avg("confidence").alias("mean_confidence"),
            F.avg(F.col("flagged_for_review").cast("double")).alias("flag_rate"),
        )
        .select(F.col("w.start").alias("window_start"), key, "n", "mean_confidence", "flag_rate")
    )


def drop_repeats(stream: DataFrame, keys: list[str], ts: str = "ts", watermark: str = "1 day") -> DataFrame:
    """Events with a key seen within the watermark go."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if not stream.isStreaming:
        return timed.dropDuplicates(keys)
    return timed.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def upsert_corrections(
    spark: SparkSession,
    root: str,
    batch: DataFrame,
    batch_id: int,
    key: str = "description",
    order: str = "ts",
    stream_id: str = "batch",
) -> None:
    """Latest correction per description after this batch; equal times go to the larger labels.

    A batch that its stream has already delivered changes nothing. Batch numbers
    are those of one stream: another stream, or one that starts anew without its
    checkpoint, has an id of its own and loses nothing.
    """
    done = read_version(spark, root, "progress")
    seen = None if done is None else done.where(F.col("stream_id") == stream_id).agg(F.max("batch_id")).first()[0]
    if seen is not None and seen >= batch_id:
        return
    labels = ["predicted_category", "correct_category"]
    new = batch.select(key, *labels, order)
    old = read_version(spark, root, "corrections")
    if old is not None:
        new = old.unionByName(new)
    new = new.groupBy(key).agg(F.max(F.struct(order, *labels)).alias("m")).select(key, "m.*").select(key, *labels, order)
    progress = spark.createDataFrame([(stream_id, batch_id)], "stream_id string, batch_id long")
    if done is not None:
        progress = done.where(F.col("stream_id") != stream_id).unionByName(progress)
    publish(spark, root, {"corrections": new, "progress": progress})


def correction_sink(stream: DataFrame, root: str, **settings) -> DataStreamWriter:
    """foreachBatch writer of the correction table at `root`, under the id that the stream's checkpoint keeps."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        upsert_corrections(spark, root, batch, batch_id, stream_id=stream_id, **settings)

    return stream.writeStream.foreachBatch(run)
