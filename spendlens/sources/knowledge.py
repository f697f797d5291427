"""Knowledge-base sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.cleaning import blank_to_null, clean_text
from spendlens.functions.names import clean_aliases, search_document, strings
from spendlens.operators.kb_build import alias_table
from spendlens.operators.ranking import top_n
from spendlens.options import DEFAULTS, Options
from spendlens.session import cut_lineage
from spendlens.sources.deltas import newest, publish_delta, read_deltas, touched

RECORDS = (
    "array<struct<entry_id:string,id:string,canonical_name:string,display_name:string,aliases:array<string>,"
    "stripped_aliases:array<string>,raw_aliases:array<string>,mapped_category:string,"
    "mapping_confidence:double,metadata_text:string,source:string,raw_category_labels:array<string>,"
    "locality:string,region:string,country:string>>"
)

ENTRY_FIELDS = [
    "entry_id", "canonical_name", "display_name", "mapped_category", "mapping_confidence", "metadata_text",
    "source", "raw_category_labels", "locality", "region", "country", "document",
]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON records with their position in the file's array.

    The array is read as one value and exploded, so positions are those of the
    file. A knowledge base too large for one file belongs in the store
    (`write_store`) or in JSON lines with a `position`, given to `load_records`.
    """
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json(F.col("value"), RECORDS)
    return whole.select(F.posexplode(parsed).alias("position", "r")).select("position", "r.*")


def load_records(records: DataFrame) -> DataFrame:
    """Records to entries: cleaned aliases with the name first, defaults filled.

    Rows without any alias go. Aliases hold all names with equal priority.
    """
    aliases = clean_aliases(F.col("aliases"))
    name = clean_text(F.col("canonical_name"))
    trimmed = lambda c: F.filter(F.transform(strings(F.col(c)), lambda v: F.trim(v)), lambda v: v != "")
    shaped = records.select(
        F.coalesce(
            blank_to_null(F.col("entry_id")), blank_to_null(F.col("id")), F.concat(F.lit("merchant:"), F.col("position"))
        ).alias("entry_id"),
        "position",
        name.alias("_name"),
        F.when((name != "") & ~F.array_contains(aliases, name), F.concat(F.array(name), aliases))
        .otherwise(aliases)
        .alias("listed"),
        clean_aliases(F.col("stripped_aliases")).alias("stripped_aliases"),
        trimmed("raw_aliases").alias("raw_aliases"),
        trimmed("raw_category_labels").alias("raw_category_labels"),
        "mapped_category",
        F.coalesce("mapping_confidence", F.lit(0.0)).alias("mapping_confidence"),
        F.trim(F.coalesce("metadata_text", F.lit(""))).alias("metadata_text"),
        F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit("external")).alias("source"),
        *[blank_to_null(F.col(c)).alias(c) for c in ("display_name", "locality", "region", "country")],
    ).where(F.size("listed") > 0)
    named = shaped.withColumn("canonical_name", F.coalesce(blank_to_null(F.col("_name")), F.col("listed")[0]))
    document = search_document(
        F.col("display_name"), F.col("canonical_name"), F.col("listed"), F.col("stripped_aliases"),
        F.col("metadata_text"), F.col("raw_category_labels"), F.col("locality"), F.col("region"), F.col("country"),
    )
    every = F.array_distinct(F.concat("listed", "stripped_aliases"))
    return named.select(
        "position",
        *[c for c in ENTRY_FIELDS if c != "document"],
        document.alias("document"),
        "stripped_aliases",
        "raw_aliases",
        F.transform(every, lambda a: F.struct(a.alias("alias"), F.lit(0).alias("priority"))).alias("aliases"),
    )


def read_kb_json(spark: SparkSession, path: str) -> DataFrame:
    return load_records(read_records(spark, path))


def merge_store(
    entries: DataFrame, old_entries: DataFrame | None, old_aliases: DataFrame | None
) -> dict[str, DataFrame]:
    """Entries kept on first write (by id and by name), aliases with their highest priority."""
    new = entries.select(*ENTRY_FIELDS)
    if old_entries is not None:
        new = new.join(old_entries, "entry_id", "left_anti").join(old_entries, "canonical_name", "left_anti")
        new = old_entries.select(*ENTRY_FIELDS).unionByName(new.select(*ENTRY_FIELDS))
    aliases = alias_table(entries)
    if old_aliases is not None:
        aliases = (
            old_aliases.unionByName(aliases).groupBy("alias", "entry_id").agg(F.max("priority").alias("priority"))
        )
    return {"entries": new, "aliases": aliases, "documents": new.select("entry_id", "document")}


_ENTRIES = (
    "entry_id string, canonical_name string, display_name string, mapped_category string, mapping_confidence double,"
    " metadata_text string, source string, raw_category_labels array<string>, locality string, region string,"
    " country string, document string"
)
_ALIASES = "alias string, entry_id string, priority int"
_VECTORS = (
    "id string, document string, embedding array<float>, canonical_name string, mapped_category string, source string"
)


def first_of_batch(entries: DataFrame) -> DataFrame:
    """One entry per id, then one per name: the first by `position` where there is one, then by all fields."""
    place = [F.col("position")] if "position" in entries.columns else []
    order = F.struct(*place, *[F.col(c) for c in ENTRY_FIELDS])
    rows = entries.select(*ENTRY_FIELDS, order.alias("_order"))
    for key in ("entry_id", "canonical_name"):
        rows = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), "_order").alias("_r")).select("_r.*")
    return rows.select(*ENTRY_FIELDS)


def write_store(spark: SparkSession, root: str, entries: DataFrame, reset: bool = False) -> int:
    """Append to the store, or rebuild it with `reset`. Returns the new version.

    An entry is kept on first write, by id and by name, inside a batch too. What the store has is looked up in the
    buckets of the batch's keys alone, and only new rows are written: entries, their names, and aliases that are new
    or have a higher priority than before.
    """
    at = None if reset else newest(spark, root)
    rows = cut_lineage(first_of_batch(entries))
    aliases = alias_table(entries).withColumn("priority", F.col("priority").cast("int"))
    if at is not None:
        ids = read_deltas(spark, root, "entries", _ENTRIES, at).select("entry_id", "bucket")
        names = read_deltas(spark, root, "names", "canonical_name string", at)
        rows = rows.join(touched(ids, "entry_id", rows, at.buckets).select("entry_id"), "entry_id", "left_anti")
        known = touched(names, "canonical_name", rows, at.buckets).select("canonical_name")
        rows = cut_lineage(rows.join(known, "canonical_name", "left_anti").select(*ENTRY_FIELDS))
        old = touched(read_deltas(spark, root, "aliases", _ALIASES, at), "alias", aliases, at.buckets)
        old = old.groupBy("alias", "entry_id").agg(F.max("priority").alias("before"))
        aliases = aliases.join(old, ["alias", "entry_id"], "left").where("before is null or priority > before")
    tables = {
        "entries": (rows, "entry_id"),
        "names": (rows.select("canonical_name"), "canonical_name"),
        "aliases": (aliases.select("alias", "entry_id", "priority"), "alias"),
    }
    return publish_delta(spark, root, tables, reset)


def read_store(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(entries, aliases with their highest priority)."""
    at = newest(spark, root)
    if at is None:
        raise FileNotFoundError(root)
    aliases = read_deltas(spark, root, "aliases", _ALIASES, at)
    return (
        read_deltas(spark, root, "entries", _ENTRIES, at).drop("delta", "bucket"),
        aliases.groupBy("alias", "entry_id").agg(F.max("priority").alias("priority")),
    )


def compact_store(spark: SparkSession, root: str) -> int:
    """All rows of a store as one delta, from which later versions start."""
    entries, aliases = read_store(spark, root)
    tables = {
        "entries": (entries, "entry_id"),
        "names": (entries.select("canonical_name"), "canonical_name"),
        "aliases": (aliases, "alias"),
    }
    return publish_delta(spark, root, tables, reset=True)


def entry_records(entries: DataFrame, aliases: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Entries with their top aliases by (priority desc, alias); the name when none."""
    top = top_n(
        aliases.select("entry_id", "alias", "priority"),
        ["entry_id"],
        [F.desc("priority"), F.asc("alias")],
        options.record_aliases,
    )
    listed = top.groupBy("entry_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "alias"))), lambda s: s["alias"]).alias("_aliases")
    )
    return (
        entries.drop("aliases")
        .join(listed, "entry_id", "left")
        .withColumn("aliases", F.coalesce("_aliases", F.array("canonical_name")))
        .drop("_aliases")
    )


def vector_rows(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors with the metadata kept beside them; blank for a missing category."""
    return vectors.join(entries.select("entry_id", "document", "canonical_name", "mapped_category", "source"), "entry_id").select(
        F.col("entry_id").alias("id"),
        "document",
        F.col("vector").alias("embedding"),
        "canonical_name",
        F.coalesce("mapped_category", F.lit("")).alias("mapped_category"),
        "source",
    )


def upsert_vectors(spark: SparkSession, root: str, rows: DataFrame, reset: bool = False) -> int:
    """New rows replace old ones of the same id. Of rows of one id in a batch the least document's stays.

    Only the batch is written; readers take the newest delta of an id.
    """
    names = [f.name for f in spark.createDataFrame([], _VECTORS).schema]
    typed = rows.select(*[F.col(n).cast("array<float>") if n == "embedding" else n for n in names])
    order = F.struct("document", F.xxhash64(F.to_json(F.struct("embedding"))))
    typed = typed.groupBy("id").agg(F.min_by(F.struct(*names), order).alias("r")).select("r.*")
    return publish_delta(spark, root, {"vectors": (typed, "id")}, reset)


def read_vectors(spark: SparkSession, root: str) -> DataFrame:
    """The newest row of each id."""
    at = newest(spark, root)
    if at is None:
        raise FileNotFoundError(root)
    rows = read_deltas(spark, root, "vectors", _VECTORS, at).drop("bucket")
    kept = F.struct(*[c for c in rows.columns if c != "delta"])
    return rows.groupBy("id").agg(F.max_by(kept, "delta").alias("r")).select("r.*")
