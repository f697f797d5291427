"""Sources and knowledge-base build."""

import uuid

from pyspark.sql import functions as F

from checks import sql as q
from checks.registry import query
from checks.views import canada, kb_entries, lines, place, seeds, table, txn
from spendlens.functions.labels import map_labels
from spendlens.operators import kb_build as kb
from spendlens.operators.embedding import hashed_vectors
from spendlens.session import cut_lineage, shared_folder
from spendlens.sources.knowledge import (
    entry_records,
    merge_store,
    read_store,
    read_vectors,
    upsert_vectors,
    vector_rows,
    write_store,
)
from spendlens.sources.places import cap_rows, latest_release, scan_places
from spendlens.sources.transactions import candidate_names, training_rows


@query("s1_scan_places", q.with_(q.PLACE) + """
SELECT position, name, locality, region, labels FROM canada""")
def s1_scan_places(spark, sf):
    return scan_places(place(spark, sf)).select("position", "name", "locality", "region", F.concat_ws("|", "labels").alias("labels"))


@query("s2_latest_release", """
WITH r AS (SELECT 'dt=2024-' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS release, p_partkey FROM part)
SELECT release, p_partkey FROM r WHERE release = (SELECT max(release) FROM r)""")
def s2_latest_release(spark, sf):
    release = F.concat(F.lit("dt=2024-"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    return latest_release(table(spark, sf, "part").select(release.alias("release"), "p_partkey"))


@query("s3_row_cap", q.with_(q.PLACE) + " SELECT position, name FROM canada ORDER BY position LIMIT 100")
def s3_row_cap(spark, sf):
    return cap_rows(canada(spark, sf).select("position", "name"), 100, [F.asc("position")])


@query("s5_candidate_names", f"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS description FROM documents),
c AS (SELECT {q.clean("description")} AS name FROM l)
SELECT DISTINCT md5(name) AS name FROM c WHERE length(name) >= 3""")
def s5_candidate_names(spark, sf):
    rows = lines(spark, sf).withColumnRenamed("line", "description")
    return candidate_names(rows).select(F.md5("name").alias("name"))


@query("s6_training_rows", q.with_(q.TXN, q.CLEANED, q.JUDGED) + """
SELECT label, count(*) AS n FROM judged WHERE cleaned <> '' GROUP BY label""")
def s6_training_rows(spark, sf):
    from checks.views import judged

    return training_rows(judged(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


@query("b1_label_map", q.with_(q.PLACE, q.KEYWORDS, q.label_map("place")) + """
SELECT p.position, m.category, round(m.confidence, 6) AS confidence FROM place p JOIN label_map m ON p.labels = m.labels""")
def b1_label_map(spark, sf):
    rows = map_labels(place(spark, sf), "labels", "m")
    return rows.select("position", F.col("m.category").alias("category"), F.round("m.confidence", 6).alias("confidence"))


MIXED = """
mixed AS (
  SELECT p_partkey AS position,
    array_to_string(list_filter([
      CASE WHEN p_size % 2 = 0 THEN 'Retail > Clothing Store' END, CASE WHEN p_size % 3 = 0 THEN 'Bank > ATM' END,
      CASE WHEN p_size % 5 = 0 THEN 'Automotive Service > Tire Shop' END, CASE WHEN p_size % 7 = 0 THEN 'Museum' END,
      CASE WHEN p_size % 11 = 0 THEN 'Odd Thing' END, p_name], lambda x: x IS NOT NULL), '|') AS labels
  FROM part)"""


@query("b2_label_ties", q.with_(MIXED, q.KEYWORDS, q.label_map("mixed")) + """
SELECT p.position, m.category, round(m.confidence, 6) AS confidence FROM mixed p JOIN label_map m ON p.labels = m.labels""")
def b2_label_ties(spark, sf):
    size = F.col("p_size")
    labels = F.array(
        F.when(size % 2 == 0, "Retail > Clothing Store"), F.when(size % 3 == 0, "Bank > ATM"),
        F.when(size % 5 == 0, "Automotive Service > Tire Shop"), F.when(size % 7 == 0, "Museum"),
        F.when(size % 11 == 0, "Odd Thing"), F.col("p_name"),
    )
    rows = table(spark, sf, "part").withColumn("labels", F.filter(labels, lambda x: x.isNotNull()))
    return map_labels(rows, "labels", "m").select(
        F.col("p_partkey").alias("position"), F.col("m.category").alias("category"), F.round("m.confidence", 6).alias("confidence")
    )


def place_entry_ctes() -> str:
    return f"""
named AS (SELECT p.*, {q.clean("name")} AS canonical_name FROM canada p),
mapped AS (SELECT n.*, m.category AS mapped_category, m.confidence AS mapping_confidence,
  {q.metadata("n.labels", "locality", "region", "'CA'")} AS metadata_text
  FROM named n JOIN label_map m ON n.labels = m.labels WHERE length(canonical_name) >= 3),
place_entries AS (SELECT position, 'foursquare:' || substr(sha1('foursquare:' || canonical_name), 1, 16) AS entry_id,
  canonical_name, trim(name) AS display_name, mapped_category, round(mapping_confidence, 6) AS mapping_confidence,
  metadata_text, 'foursquare' AS source, labels, locality, region, 'CA' AS country,
  concat_ws('. ', 'display name: ' || trim(name), 'canonical name: ' || canonical_name, 'aliases: ' || canonical_name,
    'external metadata: ' || metadata_text,
    CASE WHEN labels <> '' THEN 'place types: ' || array_to_string(string_split(labels, '|')[1:6], ' ; ') END,
    'location: ' || concat_ws(', ', locality, region, 'CA')) AS document FROM mapped)"""


SEED_ENTRIES = f"""
seed_alias AS (SELECT position, v, pos, {q.clean("v")} AS alias FROM (
  SELECT position, canonical_name AS v, 1 AS pos FROM seeds UNION ALL SELECT position, alias1, 2 FROM seeds
  UNION ALL SELECT position, alias2, 3 FROM seeds UNION ALL SELECT position, 'SQ *supplier house', 4 FROM seeds)),
seed_list AS (SELECT position, string_agg(alias, ' ; ' ORDER BY pos) AS listed FROM (
  SELECT position, alias, min(pos) AS pos FROM seed_alias WHERE length(alias) >= 3 GROUP BY ALL) GROUP BY position),
seed_entries AS (SELECT s.position, 'curated_public:' || substr(sha1('curated_public:' || {q.clean("canonical_name")}), 1, 16) AS entry_id,
  {q.clean("canonical_name")} AS canonical_name, CAST(NULL AS VARCHAR) AS display_name, mapped_category, 0.9 AS mapping_confidence,
  'wholesale supplier' AS metadata_text, 'curated_public' AS source, '' AS labels, CAST(NULL AS VARCHAR) AS locality,
  CAST(NULL AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS country,
  'canonical name: ' || {q.clean("canonical_name")} || '. aliases: ' || listed || '. alternate forms: SUPPLIER HOUSE'
  || '. external metadata: wholesale supplier' AS document
  FROM seeds s JOIN seed_list l ON s.position = l.position)"""

ENTRIES = f"""
both_entries AS (SELECT 0 AS src, * FROM seed_entries UNION ALL SELECT 1, * FROM place_entries),
entries AS MATERIALIZED (SELECT * EXCLUDE (rn, src, position) FROM (
  SELECT *, row_number() OVER (PARTITION BY canonical_name ORDER BY src, position) AS rn,
    count(*) OVER (PARTITION BY canonical_name) AS copies FROM both_entries) WHERE rn = 1)"""

KB_CTES = [q.PLACE, q.SEEDS, q.KEYWORDS, q.label_map("place"), place_entry_ctes(), SEED_ENTRIES, ENTRIES]

PLACE_ALIAS = f"""
winners AS (SELECT canonical_name, min(position) FILTER (src = 0) AS seed_pos FROM both_entries GROUP BY 1),
alias_rows AS (
  SELECT e.entry_id, e.canonical_name AS alias, 100 AS priority FROM entries e WHERE source = 'foursquare'
  UNION ALL SELECT e.entry_id, a.alias, CASE pos WHEN 1 THEN 100 WHEN 4 THEN 80 ELSE 95 END
  FROM winners w JOIN entries e ON e.canonical_name = w.canonical_name JOIN seed_alias a ON a.position = w.seed_pos
  WHERE length(a.alias) >= 3),
aliases AS MATERIALIZED (SELECT alias, entry_id, max(priority) AS priority FROM alias_rows GROUP BY ALL)"""


def flat(df, *drop):
    return df.select(
        *[c for c in df.columns if c not in ("raw_category_labels", "aliases", *drop)],
        F.concat_ws("|", "raw_category_labels").alias("labels"),
    ).withColumn("mapping_confidence", F.round("mapping_confidence", 6))


@query("b3_place_entries", q.with_(*KB_CTES) + " SELECT * FROM place_entries")
def b3_place_entries(spark, sf):
    return flat(kb.place_entries(canada(spark, sf)))


@query("b4_seed_entries", q.with_(*KB_CTES) + " SELECT * FROM seed_entries")
def b4_seed_entries(spark, sf):
    return flat(kb.seed_entries(seeds(spark, sf)))


@query("b5_first_entries", q.with_(*KB_CTES) + " SELECT * FROM entries")
def b5_first_entries(spark, sf):
    return flat(kb_entries(spark, sf))


@query("b5_duplicates", q.with_(*KB_CTES) + """
SELECT count(*) AS kept, CAST(sum(copies) AS BIGINT) AS scanned, CAST(sum(copies) - count(*) AS BIGINT) AS duplicates FROM entries""")
def b5_duplicates(spark, sf):
    return kb.duplicate_count(kb_entries(spark, sf))


@query("b6_candidates", q.with_(q.TXN, q.CLEANED, q.PLACE) + f"""
SELECT position, name FROM canada WHERE {q.clean("name")} IN (SELECT cleaned FROM raw_clean WHERE length(cleaned) >= 3)""")
def b6_candidates(spark, sf):
    names = candidate_names(txn(spark, sf), "raw")
    return kb.restrict_to_candidates(canada(spark, sf), names).select("position", "name")


NAMED = f"named AS (SELECT p.*, {q.clean('name')} AS canonical_name FROM canada p)"
LABEL_ROWS = """
label_rows AS (SELECT canonical_name, position, i AS label_pos, trim(string_split(labels, '|')[CAST(i AS INT)]) AS label
  FROM named, LATERAL (SELECT unnest(generate_series(1, len(string_split(labels, '|')))) AS i) WHERE labels <> '')"""
SHARES = """
shares AS (SELECT canonical_name, m.category, sum(m.confidence) AS score, min(position) AS seen
  FROM named n JOIN label_map m ON n.labels = m.labels WHERE m.category IS NOT NULL GROUP BY ALL)"""


@query("b7_label_counts", q.with_(q.PLACE, NAMED, LABEL_ROWS) + """
SELECT canonical_name, label, count(*) AS n FROM label_rows GROUP BY ALL""")
def b7_label_counts(spark, sf):
    rows = kb.label_rows(kb.named_places(canada(spark, sf)))
    return rows.groupBy("canonical_name", "label").agg(F.count("*").alias("n"))


@query("b7_category_sums", q.with_(q.PLACE, q.KEYWORDS, q.label_map("place"), NAMED, SHARES) + """
SELECT canonical_name, category, round(score, 6) AS score FROM shares""")
def b7_category_sums(spark, sf):
    return kb.category_shares(kb.named_places(canada(spark, sf))).select(
        "canonical_name", "category", F.round("score", 6).alias("score")
    )


@query("b8_top_labels", q.with_(q.PLACE, NAMED, LABEL_ROWS) + """
SELECT canonical_name, label, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY canonical_name ORDER BY n DESC, seen, label) AS rank
FROM (SELECT canonical_name, label, count(*) AS n, min(position * 100 + label_pos) AS seen FROM label_rows GROUP BY ALL)) WHERE rank <= 3""")
def b8_top_labels(spark, sf):
    rows = kb.label_rows(kb.named_places(canada(spark, sf)))
    return kb.most_frequent(rows, ["canonical_name"], "label", 3, "seen").select("canonical_name", "label", "n", "rank")


@query("b8_mode_locality", q.with_(q.PLACE, NAMED) + """
SELECT canonical_name, locality FROM (SELECT canonical_name, locality, row_number() OVER (PARTITION BY canonical_name ORDER BY n DESC, seen) AS r
FROM (SELECT canonical_name, locality, count(*) AS n, min(position) AS seen FROM named WHERE locality IS NOT NULL GROUP BY canonical_name, locality)) WHERE r = 1""")
def b8_mode_locality(spark, sf):
    return kb.mode_of(kb.named_places(canada(spark, sf)), "locality")


@query("b9_group_category", q.with_(q.PLACE, q.KEYWORDS, q.label_map("place"), NAMED, SHARES) + """
SELECT canonical_name, arg_max(category, round(score, 9) * 1e9 - seen / 1e6) AS mapped_category,
       round(max(score) / sum(score), 6) AS mapping_confidence FROM shares GROUP BY 1""")
def b9_group_category(spark, sf):
    best = kb.best_category(kb.category_shares(kb.named_places(canada(spark, sf))))
    return best.withColumn("mapping_confidence", F.round("mapping_confidence", 6))


@query("b7_b9_grouped_entries")
def b7_b9_grouped_entries(spark, sf):
    return kb.grouped_entries(kb.named_places(canada(spark, sf)))


def merge_input(spark, sf):
    """Entry-like rows that share names: one per part, named by its first word."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("position"),
        F.split("p_name", " ")[0].alias("canonical_name"),
        F.array("p_name", "p_brand").alias("aliases"),
        F.array(F.concat(F.lit("TST-"), F.col("p_name"))).alias("stripped_aliases"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("display_name"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Town"), F.col("p_size").cast("string"))).alias("locality"),
        F.when(F.col("p_type") == "PROMO", "Food & Dining").otherwise("Transportation").alias("mapped_category"),
        (F.col("p_size") / 100.0).alias("mapping_confidence"),
        F.array("p_type", F.lit("Shop")).alias("raw_category_labels"),
        F.when(F.col("p_partkey") % 40 == 0, F.concat(F.lit(" size "), F.col("p_size").cast("string"))).otherwise("").alias("metadata_text"),
    )


@query("b10_merge", f"""
WITH r AS (SELECT p_partkey AS position, {q.clean("string_split(p_name, ' ')[1]")} AS canonical_name, p_name, p_brand, p_size, p_type,
  {q.clean("p_name")} AS a1, {q.clean("p_brand")} AS a2 FROM part),
al AS (SELECT canonical_name, string_agg(DISTINCT a, '|' ORDER BY a) AS aliases FROM (
  SELECT canonical_name, unnest([canonical_name, a1, a2]) AS a FROM r) WHERE a <> '' GROUP BY 1),
st AS (SELECT canonical_name, string_agg(DISTINCT {q.clean("'TST-' || p_name")}, '|' ORDER BY {q.clean("'TST-' || p_name")}) AS stripped_aliases FROM r GROUP BY 1),
lb AS (SELECT canonical_name, string_agg(v, '|' ORDER BY o) AS labels FROM (
  SELECT canonical_name, v, min(o) AS o FROM (SELECT canonical_name, p_type AS v, position * 10 AS o FROM r UNION ALL
  SELECT canonical_name, 'Shop', position * 10 + 1 FROM r) GROUP BY ALL) GROUP BY 1)
SELECT r.canonical_name, count(*) AS merged, any_value(al.aliases) AS aliases, any_value(st.stripped_aliases) AS stripped_aliases,
  any_value(lb.labels) AS labels,
  arg_min(p_name, position) FILTER (p_size % 2 = 0) AS display_name,
  arg_min('Town' || p_size, position) FILTER (p_size % 3 = 0) AS locality,
  arg_max(CASE WHEN p_type = 'PROMO' THEN 'Food & Dining' ELSE 'Transportation' END, CAST(p_size AS BIGINT) * 100000000 - position) AS mapped_category,
  max(p_size) / 100.0 AS mapping_confidence,
  coalesce(string_agg('size ' || p_size, '. ' ORDER BY position) FILTER (position % 40 = 0), '') AS metadata_text
FROM r JOIN al ON r.canonical_name = al.canonical_name JOIN st ON r.canonical_name = st.canonical_name JOIN lb ON r.canonical_name = lb.canonical_name
GROUP BY r.canonical_name""")
def b10_merge(spark, sf):
    out = kb.merge_entries(merge_input(spark, sf))
    joined = [F.concat_ws("|", c).alias(n) for c, n in (("aliases", "aliases"), ("stripped_aliases", "stripped_aliases"), ("raw_category_labels", "labels"))]
    return out.select(
        "canonical_name", "merged", *joined, "display_name", "locality", "mapped_category", "mapping_confidence", "metadata_text"
    )


@query("b11_alias_table", q.with_(*KB_CTES, PLACE_ALIAS) + " SELECT alias, entry_id, priority FROM aliases")
def b11_alias_table(spark, sf):
    return kb.alias_table(kb_entries(spark, sf)).select("alias", "entry_id", "priority")


STALE = """
stale AS (SELECT p.position, p.labels, m.category AS new_cat, m.confidence AS new_conf,
  CASE position % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Charity & Donations' ELSE m.category END AS old_cat,
  CASE position % 4 WHEN 3 THEN m.confidence + 0.1 ELSE m.confidence END AS old_conf
  FROM place p JOIN label_map m ON p.labels = m.labels),
changed AS (SELECT *, CASE
  WHEN labels = '' OR (old_cat IS NOT DISTINCT FROM new_cat AND abs(new_conf - old_conf) <= 0.001) THEN 'kept'
  WHEN old_cat IS NULL AND new_cat IS NOT NULL THEN 'gained' WHEN old_cat IS NOT NULL AND new_cat IS NULL THEN 'lost'
  WHEN old_cat <> new_cat THEN 'changed' ELSE 'confidence' END AS change FROM stale)"""


def stale_entries(spark, sf):
    """Entries with categories of an older mapping: some missing, wrong or off."""
    rows = map_labels(place(spark, sf), "labels", "m").withColumnRenamed("labels", "raw_category_labels")
    kind = F.col("position") % 4
    return rows.select(
        "position",
        "raw_category_labels",
        F.when(kind == 0, F.lit(None)).when(kind == 1, "Charity & Donations").otherwise(F.col("m.category")).alias("mapped_category"),
        F.when(kind == 3, F.col("m.confidence") + 0.1).otherwise(F.col("m.confidence")).alias("mapping_confidence"),
    )


STALE_CTES = [q.PLACE, q.KEYWORDS, q.label_map("place"), STALE]


@query("b12_remap", q.with_(*STALE_CTES) + """
SELECT position, change, CASE WHEN change = 'kept' THEN old_cat ELSE new_cat END AS mapped_category,
  round(CASE WHEN change = 'kept' THEN old_conf ELSE new_conf END, 6) AS mapping_confidence FROM changed""")
def b12_remap(spark, sf):
    return kb.remap_categories(stale_entries(spark, sf)).select(
        "position", "change", "mapped_category", F.round("mapping_confidence", 6).alias("mapping_confidence")
    )


@query("b12_remap_report", q.with_(*STALE_CTES) + """
SELECT count(*) AS entries, count_if(change <> 'kept') AS updated, count_if(change = 'gained') AS gained,
  count_if(change = 'lost') AS lost, count_if(change = 'changed') AS changed, count(old_cat) AS mapped_before,
  count(CASE WHEN change = 'kept' THEN old_cat ELSE new_cat END) AS mapped_after FROM changed""")
def b12_remap_report(spark, sf):
    return kb.remap_report(kb.remap_categories(stale_entries(spark, sf)))


@query("b13_profile", q.with_(*KB_CTES) + """
SELECT count(*) AS entries, count_if(labels <> '') AS with_labels, count(mapped_category) AS with_category FROM entries""")
def b13_profile(spark, sf):
    return kb.kb_profile(kb_entries(spark, sf))


@query("s8_entry_records", q.with_(*KB_CTES, PLACE_ALIAS) + """
, top AS (SELECT entry_id, alias, row_number() OVER (PARTITION BY entry_id ORDER BY priority DESC, alias) AS r FROM aliases)
SELECT e.entry_id, e.canonical_name, coalesce(string_agg(t.alias, '|' ORDER BY r) FILTER (r <= 16), e.canonical_name) AS aliases
FROM entries e LEFT JOIN top t ON e.entry_id = t.entry_id GROUP BY e.entry_id, e.canonical_name""")
def s8_entry_records(spark, sf):
    entries = kb_entries(spark, sf)
    records = entry_records(entries, kb.alias_table(entries))
    return records.select("entry_id", "canonical_name", F.concat_ws("|", "aliases").alias("aliases"))


@query("s9_store_merge", q.with_(*KB_CTES, PLACE_ALIAS) + """
SELECT e.entry_id, count(a.alias) AS aliases, CAST(max(a.priority) AS INT) AS priority
FROM entries e JOIN aliases a ON e.entry_id = a.entry_id GROUP BY 1""")
def s9_store_merge(spark, sf):
    """Appending the same entries to a store that has them changes nothing."""
    entries = kb_entries(spark, sf)
    merged = merge_store(entries, entries, kb.alias_table(entries))
    return merged["aliases"].join(merged["entries"], "entry_id").groupBy("entry_id").agg(
        F.count("alias").alias("aliases"), F.max("priority").alias("priority")
    )


@query("s9_store_batches", q.with_(*KB_CTES) + """
SELECT entry_id, canonical_name, source, mapped_category, document FROM entries""")
def s9_store_batches(spark, sf):
    """Seeds, then places (names repeat in the batch and in the store), then all of them again."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    # Each is read by several steps of two batches, so it is made once.
    seed, place_rows = cut_lineage(kb.seed_entries(seeds(spark, sf))), cut_lineage(kb.place_entries(canada(spark, sf)))
    for batch in (seed, place_rows, seed.unionByName(place_rows)):
        write_store(spark, root, batch)
    return read_store(spark, root)[0].select("entry_id", "canonical_name", "source", "mapped_category", "document")


@query("s10_vector_upsert", """
SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS document,
  round(CAST((CASE WHEN vec_id % 3 = 0 THEN list_reverse(embedding) ELSE embedding END)[1] AS DOUBLE), 6) AS first_value
FROM embeddings
UNION ALL SELECT 'extra', 'new', 0.5""")
def s10_vector_upsert(spark, sf):
    """All vectors, then new ones for a third of the ids and for one that is not known, each twice."""
    root = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.lit("old").alias("document"), "embedding",
        F.lit("n").alias("canonical_name"), F.lit("").alias("mapped_category"), F.lit("s").alias("source"), "vec_id",
    )
    upsert_vectors(spark, root, rows)
    new = rows.where("vec_id % 3 = 0").withColumn("embedding", F.reverse("embedding"))
    extra = rows.where("vec_id = 0").withColumn("id", F.lit("extra")).withColumn("embedding", F.array(F.lit(0.5).cast("float")))
    new = new.unionByName(extra).withColumn("document", F.lit("new"))
    upsert_vectors(spark, root, new.unionByName(new))
    first = F.round(F.col("embedding")[0].cast("double"), 6)
    return read_vectors(spark, root).select("id", "document", first.alias("first_value"))


@query("s10_vector_rows")
def s10_vector_rows(spark, sf):
    entries = kb_entries(spark, sf)
    return vector_rows(entries, hashed_vectors(entries.select("entry_id", "document"), "document").select("entry_id", "vector"))


@query("e10_unmapped_labels", """
WITH l AS (SELECT unnest([p_type, p_name, 'Retail > ' || p_name]) AS label FROM part)
SELECT label, count(*) AS n FROM l WHERE NOT starts_with(label, 'Retail') AND label NOT IN (
  SELECT DISTINCT label FROM l WHERE """ + " OR ".join(
    f"contains(upper(label), {q.lit(w)})" for words in q.fixed.LABEL_KEYWORDS.values() for w in words
) + " OR contains(upper(label), 'TIRE')) GROUP BY label ORDER BY n DESC, label LIMIT 20")
def e10_unmapped_labels(spark, sf):
    from spendlens.operators.evaluate import top_unmapped_labels

    labels = F.array("p_type", "p_name", F.concat(F.lit("Retail > "), F.col("p_name")))
    return top_unmapped_labels(table(spark, sf, "part").select(labels.alias("raw_category_labels")), 20)


@query("e10_why_unmapped", q.with_(q.PLACE) + """
SELECT count(*) AS n, count_if(labels = '') AS no_labels, count_if(labels <> '') AS unmapped_labels FROM place""")
def e10_why_unmapped(spark, sf):
    from spendlens.operators.evaluate import why_unmapped

    return why_unmapped(place(spark, sf).withColumnRenamed("labels", "raw_category_labels"))
