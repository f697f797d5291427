"""Cleaning, names, rules, tokens."""

from pyspark.sql import functions as F

from checks import sql as q
from checks.registry import query
from checks.views import canada, cleaned_column, judged, lines, seeds, table, txn
from spendlens import fixed
from spendlens.functions.cleaning import clean_text, with_clean
from spendlens.functions.names import (
    alias_variants,
    clean_aliases,
    enriched_text,
    metadata_text,
    place_aliases,
    search_document,
    seed_aliases,
    stable_id,
)
from spendlens.functions.routing import is_category
from spendlens.functions.rows import exploded
from spendlens.functions.rules import detect_direction, match_rules
from spendlens.functions.tokens import analyze
from spendlens.operators.exact import brand_positions
from spendlens.operators.statements import has_activity
from spendlens.plans.classify import quick_stages


@query("n_clean_counts", q.with_(q.TXN, q.CLEANED) + """
SELECT cleaned, count(*) AS n, CAST(min(length(t.raw)) AS BIGINT) AS shortest
FROM txn t JOIN raw_clean r ON t.raw = r.raw GROUP BY cleaned""")
def n_clean_counts(spark, sf):
    rows = with_clean(txn(spark, sf).select("raw"), "raw")
    return rows.groupBy("cleaned").agg(
        F.count("*").alias("n"), F.min(F.length("raw")).cast("long").alias("shortest")
    )


@query("n2_markers", q.with_(q.TXN, q.CLEANED) + f"""
SELECT cleaned AS marker, count(*) AS n FROM txn t JOIN raw_clean r ON t.raw = r.raw
WHERE cleaned IN ({", ".join(q.lit(m) for _, m in fixed.CLEAN_MARKERS)}) GROUP BY cleaned""")
def n2_markers(spark, sf):
    marked = with_clean(txn(spark, sf).select("raw"), "raw", "marker")
    markers = [m for _, m in fixed.CLEAN_MARKERS]
    return marked.where(F.col("marker").isin(markers)).groupBy("marker").agg(F.count("*").alias("n"))


@query("n9_dirty_lines", f"""
WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT lang, {q.clean("line")} AS cleaned FROM l)
SELECT lang, count(*) AS n, count_if(cleaned = '') AS empty, CAST(sum(length(cleaned)) AS BIGINT) AS chars,
       count(DISTINCT cleaned) AS distinct_texts, min(md5(cleaned)) AS low, max(md5(cleaned)) AS high
FROM c GROUP BY lang""")
def n9_dirty_lines(spark, sf):
    cleaned = with_clean(lines(spark, sf).select("lang", "line"), "line")
    distinct = cleaned.groupBy("lang", "cleaned").agg(F.count("*").alias("k"))
    return distinct.groupBy("lang").agg(
        F.sum("k").alias("n"),
        F.sum(F.when(F.col("cleaned") == "", F.col("k")).otherwise(0)).alias("empty"),
        F.sum(F.length("cleaned") * F.col("k")).alias("chars"),
        F.count("*").alias("distinct_texts"),
        F.min(F.md5("cleaned")).alias("low"),
        F.max(F.md5("cleaned")).alias("high"),
    )


@query("n9_dirty_pages", f"SELECT page_id, md5({q.clean('html')}) AS digest FROM pages")
def n9_dirty_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(cleaned_column("html")).alias("digest"))


@query("n11_clean_aliases", f"""
WITH a AS (SELECT p_partkey, unnest([p_name, 'TST-' || p_name, p_brand, '', 'SQ *' || p_name]) AS v,
                  unnest([1, 2, 3, 4, 5]) AS i FROM part),
c AS (SELECT p_partkey, {q.clean("v")} AS alias, min(i) AS i FROM a GROUP BY ALL)
SELECT p_partkey, string_agg(alias, '|' ORDER BY i) AS aliases FROM c WHERE alias <> '' GROUP BY p_partkey""")
def n11_clean_aliases(spark, sf):
    listed = F.array(
        F.col("p_name"), F.concat(F.lit("TST-"), F.col("p_name")), F.col("p_brand"), F.lit(""),
        F.concat(F.lit("SQ *"), F.col("p_name")),
    )
    return table(spark, sf, "part").select("p_partkey", F.concat_ws("|", clean_aliases(listed)).alias("aliases"))


@query("n12_alias_variants", f"""
WITH a AS (SELECT p_partkey, unnest([p_name, p_name || ' ' || p_brand]) AS v, unnest([1, 2]) AS i FROM part),
c AS (SELECT p_partkey, i, {q.clean("v")} AS alias FROM a),
e AS (SELECT p_partkey, alias, i * 10 AS pos FROM c UNION ALL
      SELECT p_partkey, {q.drop_last("alias")} AS alias, i * 10 + 1 FROM c
      WHERE length({q.drop_last("alias")}) >= 3),
d AS (SELECT p_partkey, alias, min(pos) AS pos FROM e WHERE alias <> '' GROUP BY ALL)
SELECT p_partkey, string_agg(alias, '|' ORDER BY pos) AS aliases FROM d GROUP BY p_partkey""")
def n12_alias_variants(spark, sf):
    values = F.array(F.col("p_name"), F.concat_ws(" ", "p_name", "p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.concat_ws("|", alias_variants(values)).alias("aliases"))


@query("n13_place_aliases", f"""
WITH p AS (SELECT p_partkey, p_name || ' ' || CAST(p_size AS VARCHAR) AS name FROM part),
c AS (SELECT p_partkey, name, {q.clean("name")} AS canonical FROM p),
e AS (SELECT p_partkey, canonical AS v, 100 AS priority FROM c
      UNION ALL SELECT p_partkey, name, 90 FROM c
      UNION ALL SELECT p_partkey, {q.drop_last("canonical")}, 75 FROM c
      WHERE regexp_matches(regexp_extract(canonical, '\\S+$'), '^[0-9]+$') OR length(regexp_extract(canonical, '\\S+$')) <= 2),
k AS (SELECT p_partkey, {q.clean("v")} AS alias, priority FROM e)
SELECT p_partkey, alias, max(priority) AS priority FROM k WHERE length(alias) >= 3 GROUP BY ALL""")
def n13_place_aliases(spark, sf):
    named = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"))
    cleaned = named.withColumn("canonical", cleaned_column("name"))
    ranked = place_aliases(F.col("canonical"), F.col("name"))
    return cleaned.select("p_partkey", F.explode(ranked).alias("a")).select("p_partkey", "a.*")


@query("n14_seed_aliases", q.with_(q.SEEDS) + f""",
e AS (SELECT position, canonical_name AS v, 100 AS priority FROM seeds
      UNION ALL SELECT position, alias1, 95 FROM seeds UNION ALL SELECT position, alias2, 95 FROM seeds
      UNION ALL SELECT position, 'SQ *supplier house', 80 FROM seeds),
k AS (SELECT position, {q.clean("v")} AS alias, priority FROM e)
SELECT position, alias, max(priority) AS priority FROM k WHERE length(alias) >= 3 GROUP BY ALL""")
def n14_seed_aliases(spark, sf):
    ranked = seed_aliases(cleaned_column("canonical_name"), F.col("aliases"), F.col("stripped_aliases"))
    return seeds(spark, sf).select("position", F.explode(ranked).alias("a")).select("position", "a.*")


@query("n15_stable_id", f"""
SELECT p_partkey, 'foursquare:' || substr(sha1('foursquare:' || {q.clean("p_name")}), 1, 16) AS entry_id FROM part""")
def n15_stable_id(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", stable_id(F.lit("foursquare"), cleaned_column("p_name")).alias("entry_id")
    )


@query("n16_metadata", q.with_(q.PLACE) + f"""
SELECT position, {q.metadata("labels", "locality", "region", "country")} AS metadata FROM place""")
def n16_metadata(spark, sf):
    from checks.views import place

    return place(spark, sf).select(
        "position", metadata_text(F.col("labels"), F.col("locality"), F.col("region"), F.col("country")).alias("metadata")
    )


@query("n17_document", q.with_(q.PLACE) + f""",
c AS (SELECT *, {q.clean("name")} AS canonical, {q.metadata("labels", "locality", "region", "'CA'")} AS meta FROM canada)
SELECT position, concat_ws('. ', 'display name: ' || name, 'canonical name: ' || canonical, 'aliases: ' || canonical,
  'external metadata: ' || meta,
  CASE WHEN labels <> '' THEN 'place types: ' || array_to_string(string_split(labels, '|')[1:6], ' ; ') END,
  'location: ' || concat_ws(', ', locality, region, 'CA')) AS document FROM c""")
def n17_document(spark, sf):
    country = F.lit("CA")
    rows = canada(spark, sf).withColumn("canonical", cleaned_column("name"))
    where = [F.col("locality"), F.col("region"), country]
    return rows.select(
        "position",
        search_document(
            F.col("name"), F.col("canonical"), F.array("canonical"), F.lit(None).cast("array<string>"),
            metadata_text(F.col("labels"), *where), F.col("labels"), *where,
        ).alias("document"),
    )


@query("n18_enriched_text", q.with_(q.PLACE) + f""",
c AS (SELECT *, {q.clean("name")} AS cleaned, {q.metadata("labels", "locality", "region", "'CA'")} AS meta FROM canada)
SELECT position, concat_ws('. ', cleaned, CASE WHEN name <> cleaned THEN 'merchant identity: ' || name END,
  'external metadata: ' || meta,
  CASE WHEN labels <> '' THEN 'place types: ' || array_to_string(string_split(labels, '|')[1:3], '; ') END,
  CASE WHEN position % 2 = 0 THEN 'descriptor context: gas station, fuel' END) AS text FROM c""")
def n18_enriched_text(spark, sf):
    rows = canada(spark, sf).withColumn("cleaned", cleaned_column("name"))
    meta = metadata_text(F.col("labels"), F.col("locality"), F.col("region"), F.lit("CA"))
    context = F.when(F.col("position") % 2 == 0, "gas station, fuel").otherwise("")
    text = enriched_text(F.col("cleaned"), F.col("name"), F.col("cleaned"), meta, F.col("labels"), context)
    return rows.select("position", text.alias("text"))


@query("n19_empty_after_clean", f"""
WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT lang AS account_type, count(*) AS n, count_if({q.clean("line")} = '') AS empty FROM l GROUP BY lang""")
def n19_empty_after_clean(spark, sf):
    rows = with_clean(lines(spark, sf).select(F.col("lang").alias("account_type"), "line"), "line")
    return rows.groupBy("account_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("cleaned") == "").alias("empty")
    )


@query("r1_direction", q.with_(q.TXN, q.CLEANED) + """
SELECT direction AS category, count(*) AS n FROM txn t JOIN ruled r ON t.raw = r.raw GROUP BY direction""")
def r1_direction(spark, sf):
    found = txn(spark, sf).select(detect_direction(F.col("raw"))["category"].alias("category"))
    return found.groupBy("category").agg(F.count("*").alias("n"))


@query("r2_r5_rule_hits", q.with_(q.TXN, q.CLEANED) + """
SELECT rule AS category, rule_pattern, count(*) AS n FROM txn t JOIN ruled r ON t.raw = r.raw GROUP BY ALL""")
def r2_r5_rule_hits(spark, sf):
    rows = with_clean(txn(spark, sf).select("raw"), "raw")
    hits = rows.select(match_rules(F.col("cleaned")).alias("m"))
    return hits.groupBy(F.col("m.category").alias("category"), F.col("m.rule_pattern").alias("rule_pattern")).agg(
        F.count("*").alias("n")
    )


@query("r5_rules_on_documents", f"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT {q.clean("line")} AS cleaned FROM l)
SELECT {q.rule("cleaned", "pattern")} AS rule_pattern, count(*) AS n FROM c GROUP BY 1""")
def r5_rules_on_documents(spark, sf):
    rows = with_clean(lines(spark, sf).select("line"), "line")
    return rows.groupBy(match_rules(F.col("cleaned"))["rule_pattern"].alias("rule_pattern")).agg(F.count("*").alias("n"))


@query("r6_batch_rows", q.with_(q.TXN, q.CLEANED) + """
SELECT txn_key, t.raw, r.cleaned, coalesce(direction, rule) AS category,
       CAST(CASE WHEN direction IS NOT NULL THEN 0.99 WHEN rule IS NOT NULL THEN 0.98 END AS DOUBLE) AS confidence,
       CASE WHEN direction IS NOT NULL THEN 'direction' WHEN rule IS NOT NULL THEN 'rules' END AS source
FROM txn t JOIN ruled r ON t.raw = r.raw""")
def r6_batch_rows(spark, sf):
    return quick_stages(txn(spark, sf), "raw").select("txn_key", "raw", "cleaned", "category", "confidence", "source")


@query("r15_review_flag", q.with_(q.TXN, q.CLEANED, q.JUDGED) + """
SELECT source, flagged_for_review, count(*) AS n FROM judged GROUP BY ALL""")
def r15_review_flag(spark, sf):
    return judged(spark, sf).groupBy("source", "flagged_for_review").agg(F.count("*").alias("n"))


@query("r16_valid_labels", q.with_(q.TXN, q.CLEANED, q.JUDGED) + f"""
SELECT label, count(*) AS n FROM judged WHERE list_contains({q.CATEGORY_LIST}, label) GROUP BY label""")
def r16_valid_labels(spark, sf):
    return judged(spark, sf).where(is_category(F.col("label"))).groupBy("label").agg(F.count("*").alias("n"))


@query("r17_activity_pages", f"""
SELECT page_id, regexp_matches(lower(html), {q.lit("|".join(fixed.PAGE_WORDS))}) AS has_activity FROM pages""")
def r17_activity_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", has_activity(F.col("html")).alias("has_activity"))


HINTS = "MAP {" + ", ".join(f"{q.lit(k)}: {q.lit(v)}" for k, v in fixed.DESCRIPTOR_WORDS.items()) + "}"
PHRASES = "phrases(ord, phrase, w1, w2, hint) AS (VALUES " + ", ".join(
    f"({i}, {q.lit(p)}, {q.lit(p.split()[0])}, {q.lit(p.split()[1])}, {q.lit(h)})"
    for i, (p, h) in enumerate(fixed.DESCRIPTOR_PHRASES.items())
) + ")"
PLACES = ", ".join(q.lit(x) for x in fixed.LOCATIONS)


def role_ctes(source: str, branded: str = "") -> str:
    """CTEs over `source(text)`: tok, ph (phrase hits), roles(text, ord, token, role, hint)."""
    brand = f"WHEN EXISTS (SELECT 1 FROM {branded} b WHERE b.text = tok.text AND b.i = tok.i) THEN 'brand'" if branded else ""
    return f"""
{PHRASES},
toks AS (SELECT text, list_filter(string_split_regex(upper(trim(text)), '\\s+'), lambda x: x <> '') AS ts FROM (SELECT DISTINCT text FROM {source})),
tok AS (SELECT text, unnest(generate_series(1, len(ts))) AS i, unnest(ts) AS token FROM toks),
ph AS (SELECT a.text, p.ord, a.i, p.phrase, p.w1, p.w2, p.hint FROM tok a JOIN tok b ON a.text = b.text AND b.i = a.i + 1
       JOIN phrases p ON a.token = p.w1 AND b.token = p.w2),
taken AS (SELECT text, i FROM ph UNION SELECT text, i + 1 FROM ph),
judge AS (SELECT text, i, token, coalesce({HINTS}[token], {HINTS}[regexp_replace(token, '[.'']+$', '')]) AS h,
  CASE {brand}
       WHEN regexp_matches(token, {q.lit(fixed.NOISE_PATTERN)}) THEN 'noise' WHEN token IN ({PLACES}) THEN 'location'
       WHEN coalesce({HINTS}[token], {HINTS}[regexp_replace(token, '[.'']+$', '')]) IS NOT NULL THEN 'descriptor'
       ELSE 'brand' END AS role
  FROM tok WHERE NOT EXISTS (SELECT 1 FROM taken k WHERE k.text = tok.text AND k.i = tok.i)),
roles AS (SELECT text, i AS ord, token, role, CASE WHEN role = 'descriptor' THEN h END AS hint FROM judge
  UNION ALL SELECT text, 100000 + ord * 1000 + i * 2, w1, 'descriptor', hint FROM ph
  UNION ALL SELECT text, 100001 + ord * 1000 + i * 2, w2, 'descriptor', hint FROM ph)"""


DECOMPOSED = """
dec AS (
  SELECT t.text,
    coalesce(string_agg(token, ' ' ORDER BY ord) FILTER (role = 'brand'), t.text) AS brand_query,
    coalesce(string_agg(token, ' ' ORDER BY ord) FILTER (role = 'brand'), '') AS brand_tokens,
    coalesce(string_agg(token, ' ' ORDER BY ord) FILTER (role = 'descriptor'), '') AS descriptor_tokens,
    coalesce(string_agg(token, ' ' ORDER BY ord) FILTER (role = 'location'), '') AS location_tokens,
    coalesce(string_agg(token, ' ' ORDER BY ord) FILTER (role = 'noise'), '') AS noise_tokens
  FROM toks t LEFT JOIN roles r ON t.text = r.text GROUP BY t.text
),
hints AS (
  SELECT text, hint, min(o) AS o FROM (
    SELECT text, hint, ord * 1000 + i AS o FROM ph UNION ALL
    SELECT text, hint, 10000000 + ord FROM roles WHERE hint IS NOT NULL) GROUP BY ALL
),
context AS (SELECT text, string_agg(hint, '; ' ORDER BY o) AS descriptor_context FROM hints GROUP BY text)"""

# Windows of words that are an alias, taken greedily: three words before two, left to right, never overlapping.
BRANDED = """
windows AS (SELECT text, size, start, array_to_string(ts[start : start + size - 1], ' ') AS words
  FROM (SELECT text, ts, size, unnest(generate_series(1, len(ts) - size + 1)) AS start FROM toks, (VALUES (3), (2)) s(size)) w
  WHERE NOT EXISTS (SELECT 1 FROM taken k WHERE k.text = w.text AND k.i BETWEEN start AND start + size - 1)),
found_windows AS (SELECT text, size, start, row_number() OVER (PARTITION BY text ORDER BY size DESC, start) AS n
  FROM windows WHERE words IN (SELECT alias FROM {names})),
picked AS (SELECT DISTINCT text, 0 AS n, CAST([] AS BIGINT[]) AS pos FROM found_windows
  UNION ALL SELECT p.text, h.n, CASE WHEN list_has_any(pos, generate_series(start, start + size - 1)) THEN pos
    ELSE list_concat(pos, generate_series(start, start + size - 1)) END
  FROM picked p JOIN found_windows h ON h.text = p.text AND h.n = p.n + 1),
branded AS (SELECT text, unnest(arg_max(pos, n)) AS i FROM picked GROUP BY text),
judge AS"""


def branded_roles(names: str) -> str:
    return role_ctes("texts", "branded").replace("judge AS", BRANDED.format(names=names).strip(), 1)


def recursive(*ctes: str) -> str:
    return q.with_(*ctes).replace("WITH", "WITH RECURSIVE", 1)


CLEAN_TEXTS = "texts AS (SELECT DISTINCT cleaned AS text FROM raw_clean)"
LINE_TEXTS = f"""texts AS (SELECT DISTINCT {q.clean("line")} || CASE WHEN length(line) % 3 = 0 THEN ' GAS BAR CONV.' ELSE ' 12 OTTAWA' END AS text
  FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))"""


def distinct_texts(spark, sf):
    return with_clean(txn(spark, sf).select("raw"), "raw", "text").select("text").distinct()


def line_texts(spark, sf):
    tail = F.when(F.length("line") % 3 == 0, " GAS BAR CONV.").otherwise(" 12 OTTAWA")
    cleaned = with_clean(lines(spark, sf).select("line"), "line")
    return cleaned.select(F.concat("cleaned", tail).alias("text")).distinct()


def flat_roles(texts):
    return analyze(texts, "text", "a").select(
        "text",
        F.col("a.brand_query").alias("brand_query"),
        *[F.concat_ws(" ", f"a.{r}_tokens").alias(f"{r}_tokens") for r in ("brand", "descriptor", "location", "noise")],
    )


@query("k_token_roles", q.with_(q.TXN, q.CLEANED, CLEAN_TEXTS, role_ctes("texts"), DECOMPOSED) + " SELECT * FROM dec")
def k_token_roles(spark, sf):
    return flat_roles(distinct_texts(spark, sf))


@query("k_token_roles_lines", q.with_(LINE_TEXTS, role_ctes("texts"), DECOMPOSED) + """
SELECT md5(text) AS text_key, md5(brand_query) AS brand_query, descriptor_tokens, location_tokens, noise_tokens FROM dec""")
def k_token_roles_lines(spark, sf):
    return flat_roles(line_texts(spark, sf)).select(
        F.md5("text").alias("text_key"), F.md5("brand_query").alias("brand_query"),
        "descriptor_tokens", "location_tokens", "noise_tokens",
    )


@query("k9_descriptor_context", q.with_(q.TXN, q.CLEANED, CLEAN_TEXTS, role_ctes("texts"), DECOMPOSED) + """
SELECT t.text, coalesce(descriptor_context, '') AS descriptor_context FROM texts t LEFT JOIN context c ON t.text = c.text""")
def k9_descriptor_context(spark, sf):
    return analyze(distinct_texts(spark, sf), "text", "a").select(
        "text", F.col("a.descriptor_context").alias("descriptor_context")
    )


@query("k10_role_stats", q.with_(LINE_TEXTS, role_ctes("texts")) + """
SELECT role, token, count(*) AS n FROM roles GROUP BY ALL""")
def k10_role_stats(spark, sf):
    roles = exploded(analyze(line_texts(spark, sf), "text", "a"), [], "a.token_roles", "r")
    return roles.groupBy("r.role", "r.token").agg(F.count("*").alias("n"))


@query("k3_brand_windows", recursive(q.PLACE, q.TXN, q.CLEANED, CLEAN_TEXTS,
       f"place_names AS (SELECT DISTINCT {q.clean('name')} AS alias FROM canada)", branded_roles("place_names")) + """,
last_pick AS (SELECT text, arg_max(pos, n) AS pos FROM picked GROUP BY text)
SELECT t.text, coalesce(array_to_string(pos, ','), '') AS positions FROM texts t LEFT JOIN last_pick p ON p.text = t.text""")
def k3_brand_windows(spark, sf):
    """Greedy brand windows of all transaction texts against all place names."""
    aliases = canada(spark, sf).select(clean_text(F.col("name")).alias("alias")).distinct()
    texts = distinct_texts(spark, sf)
    found = brand_positions(texts, aliases, "text")
    return texts.join(found, "text", "left").select(
        "text", F.concat_ws(",", F.col("brand_positions").cast("array<string>")).alias("positions")
    )
