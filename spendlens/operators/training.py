"""Training-set jobs: splits, samples, augmentation, enrichment, pairs, pseudo-labels.

Every random choice is a digest of a seed and the row id, so a rerun or a lost
executor gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.cleaning import with_clean
from spendlens.functions.labels import map_labels
from spendlens.functions.names import strings
from spendlens.functions.rows import exploded, posexploded
from spendlens.operators.ranking import hashed_rank
from spendlens.session import cut_lineage

SEED = 42
SPLIT = (0.8, 0.9)


def digest(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def digest_part(hexes: Column, part: int) -> Column:
    """The part-th block of seven hex digits as a number."""
    return F.conv(F.substring(hexes, 1 + 7 * part, 7), 16, 10).cast("long")


def clean_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows with a cleaned text; empty ones dropped."""
    return with_clean(df, text).where(F.col("cleaned") != "")


def stratified_split(df: DataFrame, ids: list[str], label: str, seed: int = SEED) -> DataFrame:
    """`split` of train, val or test: 80/10/10 within every class, exactly.

    The ids must be unique.
    """
    ranked = hashed_rank(df.withColumn("_digest", digest(seed, *ids)), [label], "_digest", "_rank", "_size")
    split = (
        F.when(F.col("_rank") <= F.floor(F.col("_size") * SPLIT[0]), "train")
        .when(F.col("_rank") <= F.floor(F.col("_size") * SPLIT[1]), "val")
        .otherwise("test")
    )
    return ranked.withColumn("split", split).drop("_digest", "_rank", "_size")


def stratified_sample(df: DataFrame, ids: list[str], label: str, size: int, classes: int = 10, seed: int = SEED) -> DataFrame:
    """max(1, size // classes) rows per class, or all of a smaller class."""
    quota = max(1, size // classes)
    ranked = hashed_rank(df.withColumn("_digest", digest(seed, *ids)), [label], "_digest", "_rank")
    return ranked.where(F.col("_rank") <= quota).drop("_digest", "_rank")


def uniform_sample(df: DataFrame, ids: list[str], size: int, seed: int = SEED) -> DataFrame:
    """`size` rows in digest order."""
    return df.withColumn("_digest", digest(seed, *ids)).orderBy("_digest").limit(size).drop("_digest")


def shrink_words(text: Column, keep: int) -> Column:
    """Vowels dropped from each word after its first `keep` letters."""
    return F.concat_ws(
        " ",
        F.transform(
            F.split(text, " "),
            lambda w: F.concat(
                F.substring(w, 1, keep), F.regexp_replace(F.substr(w, F.lit(keep + 1)), "[AEIOU]", "")
            ),
        ),
    )


def abbreviations(text: Column, hexes: Column) -> Column:
    """The six abbreviated forms of an upper-case text, in fixed order."""
    words = F.split(text, " ")
    cut = F.rtrim(F.substring(text, F.lit(1), (F.lit(15) + digest_part(hexes, 1) % 11).cast("int")))
    short_word = F.concat_ws(" ", F.transform(words, lambda w, i: F.when(i == 0, F.substring(w, 1, 4)).otherwise(w)))
    no_last = F.concat_ws(" ", F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))))
    acronym = F.when(
        F.size(words) > 1, F.concat_ws("", F.transform(words, lambda w: F.substring(w, 1, 1)))
    ).otherwise(text)
    return F.array(cut, shrink_words(text, 1), shrink_words(text, 2), short_word, no_last, acronym)


def augment(df: DataFrame, ids: list[str], text: str, per_row: int = 3, seed: int = SEED) -> DataFrame:
    """Original rows and up to `per_row` distinct abbreviated variants each, same label.

    `variant` is 0 for the original, else 1 to per_row.
    """
    hexes = digest(seed, *ids)
    start = digest_part(hexes, 0)
    forms = abbreviations(F.col(text), hexes)
    picked = F.array(*[F.element_at(forms, (1 + (start + k) % 6).cast("int")) for k in range(per_row)])
    useful = F.array_distinct(F.filter(picked, lambda v: (v != F.col(text)) & (v != "")))
    every = F.concat(F.array(F.col(text)), useful)
    rest = [c for c in df.columns if c != text]
    return posexploded(df, rest, every, "variant", text)


def label_pool(entries: DataFrame) -> DataFrame:
    """Distinct label paths that by themselves map to their entry's category.

    Columns: category, label, idx (from 0 within the category), size.
    """
    mapped = entries.where(F.col("mapped_category").isNotNull())
    pairs = exploded(
        mapped, [F.col("mapped_category").alias("category")], strings(F.col("raw_category_labels")), "label"
    )
    alone = map_labels(pairs.distinct().withColumn("one", F.array("label")), "one", "m")
    own = alone.where(F.col("m.category").eqNullSafe(F.col("category"))).select("category", "label")
    ranked = hashed_rank(own.withColumn("_digest", F.md5("label")), ["category"], "_digest", "_rank", "size")
    return ranked.select("category", "label", (F.col("_rank") - 1).alias("idx"), "size")


def location_pool(entries: DataFrame) -> DataFrame:
    """Distinct (locality, region) of the entries, numbered from 0, with their count."""
    places = entries.where(F.col("locality").isNotNull()).select(
        F.concat_ws(", ", "locality", "region", "country").alias("place")
    ).distinct()
    ranked = hashed_rank(places.withColumn("_digest", F.md5("place")), [], "_digest", "_rank", "size")
    return ranked.select("place", (F.col("_rank") - 1).alias("idx"), "size")


def enrich(
    df: DataFrame,
    ids: list[str],
    text: str,
    label: str,
    labels: DataFrame,
    places: DataFrame,
    seed: int = SEED,
) -> DataFrame:
    """`model_text`: half of the rows with place metadata drawn for their category.

    Shares: 50% enriched; templates 30/25/25/20%; 8% with a label of another
    category; 40% with a location. Classes without labels keep their text.
    """
    classes = labels.groupBy("category").agg(F.first("size").alias("size"))
    classes = classes.withColumn("pos", F.row_number().over(Window.orderBy("category")) - 1)
    class_count = classes.agg(F.count("*")).scalar()
    place_count = F.coalesce(places.agg(F.max("size")).scalar(), F.lit(0))
    hexes = digest(seed, *ids)
    drawn = df.select(
        "*",
        *[digest_part(hexes, i).alias(f"_h{i}") for i in range(4)],
        digest_part(F.md5(hexes), 0).alias("_h4"),
        digest_part(F.md5(hexes), 1).alias("_h5"),
    )
    own = classes.select(F.col("category").alias("_own"), F.col("pos").alias("_own_pos"))
    placed = drawn.join(F.broadcast(own), F.col(label) == F.col("_own"), "left")
    wrong = (F.col("_h2") % 100 < 8) & (class_count > 1)
    target = F.when(
        wrong, (F.col("_own_pos") + 1 + F.col("_h4") % F.greatest(class_count - 1, F.lit(1))) % class_count
    ).otherwise(F.col("_own_pos"))
    wanted = placed.withColumn("_pos", F.when(F.col("_h0") % 100 < 50, target))
    sized = wanted.join(
        F.broadcast(classes.select(F.col("pos").alias("_p"), F.col("category").alias("_cat"), F.col("size").alias("_size"))),
        F.col("_pos") == F.col("_p"),
        "left",
    )
    indexed = sized.withColumn("_idx", F.col("_h5") % F.col("_size")).withColumn(
        "_place_idx",
        F.when(
            F.col("_cat").isNotNull() & (F.col("_h3") % 100 < 40) & (place_count > 0),
            F.col("_h4") % F.nullif(place_count, F.lit(0)),
        ),
    )
    pool = labels.select(F.col("category").alias("_pc"), F.col("idx").alias("_pi"), F.col("label").alias("_label"))
    spots = places.select(F.col("idx").alias("_si"), F.col("place").alias("_place"))
    # Rows that draw nothing get keys of their own, which no label or place has, so they do not meet in one task.
    keyed = indexed.withColumn("_idx", F.coalesce("_idx", -1 - F.col("_h0"))).withColumn(
        "_place_idx", F.coalesce("_place_idx", -1 - F.col("_h0"))
    )
    drawn_label = (F.coalesce("_cat", F.lit("")) == F.col("_pc")) & (F.col("_idx") == F.col("_pi"))
    joined = keyed.join(pool, drawn_label, "left").join(spots, F.col("_place_idx") == F.col("_si"), "left")
    types = F.concat(F.lit("place types: "), F.col("_label"))
    metadata = F.concat(
        F.lit("external metadata: "),
        F.concat_ws(". ", types, F.when(F.col("_place").isNotNull(), F.concat(F.lit("location: "), F.col("_place")))),
    )
    identity = F.concat(F.lit("merchant identity: "), F.initcap(F.col(text)))
    base, kind = F.col(text), F.col("_h1") % 100
    enriched = (
        F.when(kind < 30, F.concat_ws(". ", base, metadata, types))
        .when(kind < 55, F.concat_ws(". ", base, metadata))
        .when(kind < 80, F.concat_ws(". ", base, types))
        .otherwise(F.concat_ws(". ", base, identity, metadata, types))
    )
    return joined.select(
        *df.columns, F.when(F.col("_label").isNotNull(), enriched).otherwise(base).alias("model_text")
    )


def distant_pairs(entries: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Distinct (text, category) of names and aliases of confidently mapped entries."""
    kept = entries.where(F.col("mapped_category").isNotNull() & (F.col("mapping_confidence") >= min_confidence))
    names = F.array_distinct(
        F.concat(F.array("canonical_name"), F.transform("aliases", lambda a: a["alias"]))
    )
    return exploded(kept, [F.col("mapped_category").alias("category")], names, "text").distinct()


def positive_pairs(entries: DataFrame) -> DataFrame:
    """Distinct (anchor, positive): a name and each other alias of the same entry."""
    return (
        exploded(entries, [F.col("canonical_name").alias("anchor")], "aliases", "a")
        .select("anchor", F.col("a.alias").alias("positive"))
        .where(F.col("positive") != F.col("anchor"))
        .distinct()
    )


def negative_pairs(entries: DataFrame, seed: int = SEED) -> DataFrame:
    """(anchor, negative): each mapped name with one name of another category."""
    mapped = entries.where(F.col("mapped_category").isNotNull()).select(
        "entry_id", "canonical_name", F.col("mapped_category").alias("category")
    )
    ranked = hashed_rank(
        mapped.withColumn("_digest", digest(seed, "entry_id")), ["category"], "_digest", "_rank", "_size"
    )
    classes = ranked.groupBy("category").agg(F.first("_size").alias("size"))
    classes = classes.withColumn("pos", F.row_number().over(Window.orderBy("category")) - 1)
    n = classes.agg(F.count("*")).scalar()
    own = classes.select(F.col("category").alias("_own"), F.col("pos").alias("_own_pos"))
    hexes = digest(seed + 1, "entry_id")
    asked = ranked.join(F.broadcast(own), F.col("category") == F.col("_own")).withColumn(
        "_pos",
        F.when(n > 1, (F.col("_own_pos") + 1 + digest_part(hexes, 0) % F.greatest(n - 1, F.lit(1))) % n),
    )
    other = classes.select(F.col("pos").alias("_p"), F.col("category").alias("_cat"), F.col("size").alias("_n"))
    sized = asked.join(F.broadcast(other), F.col("_pos") == F.col("_p")).withColumn(
        "_idx", 1 + digest_part(hexes, 1) % F.col("_n")
    )
    pool = ranked.select(
        F.col("category").alias("negative_category"), F.col("_rank").alias("_r"), F.col("canonical_name").alias("negative")
    )
    return sized.join(
        pool, (F.col("_cat") == F.col("negative_category")) & (F.col("_idx") == F.col("_r"))
    ).select(F.col("canonical_name").alias("anchor"), "category", "negative", "negative_category")


def pseudo_labels(
    df: DataFrame,
    threshold: float = 0.9,
    top_share: float = 0.2,
    class_thresholds: dict[str, float] | None = None,
    digits: int = 4,
) -> DataFrame:
    """Confident predictions within the top share of their class.

    Shares are ranks over distinct rounded confidences, at most 10**digits + 1
    per class, so no class is sorted as a whole. Rows of equal rounded
    confidence share a rank. Predictions are counted and then filtered, so they
    are written once.
    """
    needed = F.lit(threshold)
    for name, value in (class_thresholds or {}).items():
        needed = F.when(F.col("category") == name, F.lit(value)).otherwise(needed)
    rounded = cut_lineage(df).withColumn("_c", F.round("confidence", digits))
    counts = rounded.groupBy("category", "_c").agg(F.count("*").alias("_n"))
    above = Window.partitionBy("category").orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("category")
    shares = counts.select(
        F.col("category").alias("_cat"),
        F.col("_c").alias("_level"),
        (F.coalesce(F.sum("_n").over(above), F.lit(0)) / F.nullif(F.sum("_n").over(whole) - 1, F.lit(0))).alias("_share"),
    )
    joined = rounded.join(shares, (F.col("category") == F.col("_cat")) & (F.col("_c") == F.col("_level")))
    return joined.where(
        (F.col("confidence") >= needed) & (F.coalesce("_share", F.lit(0.0)) <= top_share)
    ).select(*df.columns)
