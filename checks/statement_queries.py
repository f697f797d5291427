"""Statement lines, label collection, corrections, streaming."""

import uuid

from pyspark.sql import functions as F

from checks import sql as q
from checks.registry import query
from checks.search_queries import CASCADE, FULL_SEARCH, Letters, full_knowledge
from checks.text_queries import recursive
from checks.views import judged, lines, statement_lines, table, txn
from spendlens import fixed
from spendlens.operators import labelling as lb
from spendlens.operators import statements as st
from spendlens.session import shared_folder
from spendlens.functions.white import strip
from spendlens.streaming.jobs import batch_folders, classify_batches, classify_stream, correction_sink, drop_repeats, monitor


def any_match(col: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {q.lit(p)})" for p in patterns) + ")"


def in_list(col: str, values: list[str]) -> str:
    return f"{col} IN ({', '.join(q.lit(v) for v in values)})"


def starts(col: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({col}, {q.lit(v)})" for v in values) + ")"


HEADERS = [*fixed.CARD_HEADERS, *fixed.ACCOUNT_HEADERS]
KIND = f"""CASE WHEN line IN ('', '.') THEN 'blank'
  WHEN contains(line, 'Closing Balance') OR starts_with(line, 'Please check') OR {starts("line", fixed.CARD_STOPS)} THEN 'stop'
  WHEN {in_list("line", HEADERS)} THEN 'header' WHEN {any_match("line", [fixed.CARD_DATE, fixed.ACCOUNT_DATE])} THEN 'date'
  WHEN {any_match("line", [fixed.REFERENCE_NUMBER])} THEN 'reference' WHEN {any_match("line", [fixed.AMOUNT_LINE])} THEN 'amount'
  WHEN {any_match("line", [fixed.FOREX_LINE])} THEN 'forex' WHEN {any_match("line", fixed.BOILERPLATE)} THEN 'boilerplate' ELSE 'text' END"""

STATEMENT = """
li AS (SELECT txn_key // 10 AS page, '2|' || lpad(CAST(txn_key AS VARCHAR), 12, '0') || '|' || raw || '|' || printf('%015.2f', amount) AS item,
  unnest([CAST(day(posted_at) AS VARCHAR) || ' Jan', substr(raw, 1, 12), substr(raw, 13), '$' || CAST(CAST(round(amount) AS BIGINT) AS VARCHAR) || '.00', chr(9) || 'Royal Bank of Canada' || chr(160) || chr(13)]) AS line,
  unnest([0, 1, 2, 3, 4]) AS part FROM txn),
pg AS (SELECT DISTINCT page FROM li),
sl AS (SELECT * FROM li UNION ALL
  SELECT page, '1', unnest(['Your account number', 'Before the start', 'Details of your account activity', 'Date' || chr(13)]), unnest([0, 1, 2, 3]) FROM pg UNION ALL
  SELECT page, '3', unnest(['last open line', 'Closing Balance', 'Behind the end']), unnest([0, 1, 2]) FROM pg)"""


@query("l1_line_kinds", q.with_(q.TXN, STATEMENT) + f"""
, k AS (SELECT {q.strip('line')} AS line FROM sl UNION ALL SELECT {q.strip('unnest(string_split(text, chr(10)))')} FROM documents)
SELECT {KIND} AS kind, count(*) AS n FROM k GROUP BY 1""")
def l1_line_kinds(spark, sf):
    rows = statement_lines(spark, sf).select(strip(F.col("line")).alias("line")).unionByName(lines(spark, sf).select(strip(F.col("line")).alias("line")))
    return rows.groupBy(st.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


ISLANDS = f"""
, ordered AS (SELECT page, {q.strip('line')} AS line, row_number() OVER (PARTITION BY page ORDER BY item, part) AS no FROM sl),
section AS (SELECT page, line, no FROM (SELECT *, min(no) FILTER (contains(line, 'Details of your account activity') OR contains(line, 'Opening Balance')) OVER (PARTITION BY page) AS s FROM ordered) WHERE no > s),
body AS (SELECT page, line, no FROM (SELECT *, min(no) FILTER (contains(line, 'Closing Balance') OR starts_with(line, 'Please check')) OVER (PARTITION BY page) AS e FROM section) WHERE e IS NULL OR no < e),
useful AS (SELECT *, {any_match("line", [fixed.ACCOUNT_DATE, fixed.AMOUNT_LINE])} AS boundary FROM body
  WHERE line NOT IN ('', '.') AND NOT {in_list("line", HEADERS)} AND NOT {any_match("line", fixed.BOILERPLATE)}),
marked AS (SELECT *, sum(CAST(boundary AS INT)) OVER (PARTITION BY page ORDER BY no) AS g FROM useful),
islands AS (SELECT page, g, string_agg(line, ' ' ORDER BY no) AS description FROM marked WHERE NOT boundary GROUP BY ALL)"""


def pages(spark, sf):
    return st.pages_from_lines(statement_lines(spark, sf).withColumn("at", F.struct("item", "part")), ["page"], "at", "line").withColumn(
        "account_type", F.lit("chequing")
    )


@query("l2_line_islands", q.with_(q.TXN, STATEMENT) + ISLANDS + """
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY g) - 1 AS INT) AS pos, description FROM islands""")
def l2_line_islands(spark, sf):
    return st.descriptions(pages(spark, sf), "text", "account_type").select("page", "pos", "description")


CARD_PAGE = """concat_ws(chr(10), 'Head', 'ACTIVITY DESCRIPTION', 'DATE', 'AMOUNT ($)', text, 'DEC 08', '123456789012345678', 'JAN 2 EXTRA SHOP', '-$12.50', 'Exchange rate 1.2', 'Cash Back on food',
  CASE WHEN doc_id % 2 = 0 THEN 'CONTACT US' END, 'After')"""


@query("l3_card_lines", f"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS no FROM (SELECT doc_id, {CARD_PAGE} AS text FROM documents)),
t AS (SELECT doc_id, no, {q.strip('line')} AS line FROM p),
a AS (SELECT * FROM (SELECT *, min(no) FILTER (contains(line, 'ACTIVITY DESCRIPTION')) OVER (PARTITION BY doc_id) AS s FROM t) WHERE no > s),
b AS (SELECT * FROM (SELECT doc_id, no, line, min(no) FILTER ({starts("line", fixed.CARD_STOPS)}) OVER (PARTITION BY doc_id) AS e FROM a) WHERE e IS NULL OR no < e),
c AS (SELECT * FROM (SELECT doc_id, no, line, min(no) FILTER (line NOT IN ('AMOUNT ($)', 'DATE', '')) OVER (PARTITION BY doc_id) AS f FROM b) WHERE no >= f),
k AS (SELECT doc_id, no, {q.strip('regexp_replace(line, ' + q.lit(fixed.CARD_LEADING_DATE) + ", '')")} AS line FROM c WHERE line NOT IN ('', '.')
  AND NOT {any_match("line", [fixed.CARD_DATE, fixed.REFERENCE_NUMBER, fixed.AMOUNT_LINE, fixed.FOREX_LINE, fixed.CARD_REWARD_LINE])})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS INT) AS pos, md5(line) AS description FROM k WHERE line <> ''""")
def l3_card_lines(spark, sf):
    page = F.concat_ws(
        "\n", F.lit("Head"), F.lit("ACTIVITY DESCRIPTION"), F.lit("DATE"), F.lit("AMOUNT ($)"), "text", F.lit("DEC 08"),
        F.lit("123456789012345678"), F.lit("JAN 2 EXTRA SHOP"), F.lit("-$12.50"), F.lit("Exchange rate 1.2"), F.lit("Cash Back on food"),
        F.when(F.col("doc_id") % 2 == 0, "CONTACT US"), F.lit("After"),
    )
    rows = table(spark, sf, "documents").select("doc_id", page.alias("text"), F.lit("mastercard").alias("account_type"))
    return st.descriptions(rows, "text", "account_type").select("doc_id", "pos", F.md5("description").alias("description"))


@query("l4_statement_summary", q.with_(q.TXN) + """
SELECT account_type, count(*) AS n, count_if(amount % 2 < 1) AS debits, count_if(amount % 2 >= 1) AS credits, round(sum(amount), 2) AS amount FROM txn GROUP BY account_type""")
def l4_statement_summary(spark, sf):
    rows = txn(spark, sf).withColumn("type", F.when(F.col("amount") % 2 < 1, "debit").otherwise("credit"))
    return st.statement_summary(rows).withColumn("amount", F.round("amount", 2))


@query("l5_label_batches", q.with_(q.TXN) + """
, r AS (SELECT raw, row_number() OVER (ORDER BY md5(raw)) AS rn FROM (SELECT DISTINCT raw FROM txn))
SELECT (rn - 1) // 30 + 1 AS batch, count(*) AS n, 'Label:' || chr(10) || string_agg('- "' || raw || '"', chr(10) ORDER BY rn) AS prompt FROM r GROUP BY 1""")
def l5_label_batches(spark, sf):
    return lb.label_batches(txn(spark, sf), "raw", 30, "Label:\n{transactions}")


RESPONSES = """
re AS (SELECT p_partkey, '[{"description": "' || p_name || '", "category": "' || CASE WHEN p_size % 3 = 0 THEN 'Odd' ELSE 'Income' END || '"}, {"description": "' || p_brand || '", "category": "Transportation"}' AS body FROM part)"""


@query("l6_parse_responses", q.with_(RESPONSES) + """
SELECT p_partkey, p_name AS description, 'Income' AS category FROM part WHERE p_size % 3 <> 0 AND p_partkey % 5 <> 4
UNION ALL SELECT p_partkey, p_brand, 'Transportation' FROM part WHERE p_partkey % 5 <> 4""")
def l6_parse_responses(spark, sf):
    """Plain, fenced, noisy, truncated and broken responses by part key."""
    body = F.concat(
        F.lit('[{"description": "'), "p_name", F.lit('", "category": "'), F.when(F.col("p_size") % 3 == 0, "Odd").otherwise("Income"),
        F.lit('"}, {"description": "'), "p_brand", F.lit('", "category": "Transportation"}'),
    )
    kind = F.col("p_partkey") % 5
    response = (
        F.when(kind == 0, F.concat(body, F.lit("]")))
        .when(kind == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("]\n```\nbye")))
        .when(kind == 2, F.concat(F.lit("(node) DeprecationWarning: x\n```\n"), body, F.lit("]\n```")))
        .when(kind == 3, F.concat(body, F.lit(', {"description": "cut of')))
        .otherwise(F.lit("no idea"))
    )
    rows = table(spark, sf, "part").select("p_partkey", response.alias("response"))
    return lb.parse_responses(rows, "response").select("p_partkey", "description", "category")


LOG = f"""
log AS (SELECT 'user ' || user_id AS description, ts, event_id, {q.CATEGORY_LIST}[CAST(user_id % 10 AS INT) + 1] AS predicted_category,
  {q.CATEGORY_LIST}[CAST(event_id % 10 AS INT) + 1] AS correct_category FROM events),
latest AS (SELECT description, arg_max(predicted_category, event_id) AS predicted_category, arg_max(correct_category, event_id) AS correct_category, count(*) AS corrections FROM log GROUP BY description)"""


def correction_log(spark, sf, events=None):
    names = F.array(*[F.lit(c) for c in fixed.CATEGORIES])
    events = table(spark, sf, "events") if events is None else events
    return events.select(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("description"),
        "ts",
        "event_id",
        F.get(names, (F.col("user_id") % 10).cast("int")).alias("predicted_category"),
        F.get(names, (F.col("event_id") % 10).cast("int")).alias("correct_category"),
    )


@query("l7_latest_corrections", q.with_(LOG) + " SELECT * FROM latest")
def l7_latest_corrections(spark, sf):
    return lb.latest_corrections(correction_log(spark, sf), order=["event_id"])


@query("l7_apply_corrections", q.with_(LOG) + """
, e AS (SELECT 'user ' || user_id AS description, event_id, 'Income' AS category FROM events)
SELECT e.description, e.event_id, coalesce(correct_category, category) AS category, coalesce(correct_category <> category, false) AS corrected
FROM e LEFT JOIN latest l ON l.description = e.description""")
def l7_apply_corrections(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("description"), "event_id", F.lit("Income").alias("category")
    )
    return lb.apply_corrections(rows, lb.latest_corrections(correction_log(spark, sf), order=["event_id"]))


@query("l7_disagreement", q.with_(LOG) + """
SELECT CAST(ts AS DATE) AS period, predicted_category AS category, count(*) AS n, round(avg(CAST(predicted_category <> correct_category AS INT)), 6) AS rate FROM log GROUP BY ALL""")
def l7_disagreement(spark, sf):
    return lb.disagreement(correction_log(spark, sf), F.to_date("ts")).withColumn("rate", F.round("rate", 6))


@query("l7_merchant_override", q.with_(q.TXN, q.CLEANED, q.JUDGED) + """
SELECT CASE WHEN length(cleaned) % 5 = 0 THEN 'Shopping & Retail' ELSE category END AS category, count(*) AS n FROM judged GROUP BY 1""")
def l7_merchant_override(spark, sf):
    rows = judged(spark, sf)
    names = rows.select(F.col("cleaned").alias("merchant")).distinct().where(F.length("merchant") % 5 == 0)
    overrides = names.withColumn("category", F.lit("Shopping & Retail"))
    return lb.override_merchants(rows, overrides, "cleaned").groupBy("category").agg(F.count("*").alias("n"))


@query("l8_review_queue", q.with_(q.TXN, q.CLEANED, q.JUDGED, q.PLACE) + f"""
, known AS (SELECT DISTINCT {q.clean("name")} AS name FROM canada)
SELECT cleaned, category, confidence, cleaned NOT IN (SELECT name FROM known) AS is_new, coalesce('Income' <> category, false) AS disagrees,
  round(abs(confidence - 0.7), 6) AS margin FROM judged WHERE flagged_for_review""")
def l8_review_queue(spark, sf):
    from checks.views import canada
    from spendlens.functions.cleaning import with_clean

    known = with_clean(canada(spark, sf).select(F.col("name").alias("place")), "place", "name")
    rows = judged(spark, sf).withColumn("rule", F.lit("Income"))
    queue = lb.review_queue(rows, known, "cleaned", "rule")
    return queue.select("cleaned", "category", "confidence", "is_new", "disagrees", "margin")


def run_stream(df, mode):
    """The result of a stream over the files there are, written to files by the executors."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/spendlens-stream-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/rows")
    else:
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/rows"))
    writer.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


EVENT_TEXT = "CASE event_type WHEN 'purchase' THEN 'POS PURCHASE - 1234 SHOP ' || (user_id % 7) || ' OTTAWA ON' WHEN 'signup' THEN 'Payroll Deposit X' WHEN 'view' THEN 'PARKING LOT' ELSE 'REFUND' END"


def event_text():
    kind = F.col("event_type")
    return (
        F.when(kind == "purchase", F.concat(F.lit("POS PURCHASE - 1234 SHOP "), (F.col("user_id") % 7).cast("string"), F.lit(" OTTAWA ON")))
        .when(kind == "signup", "Payroll Deposit X").when(kind == "view", "PARKING LOT").otherwise("REFUND")
    )


EVENT_CTE = f"""
ev AS (SELECT event_id, ts, {EVENT_TEXT} AS raw FROM events),
ec AS (SELECT event_id, ts, raw, {q.clean("raw")} AS cleaned FROM ev),
er AS (SELECT *, {q.direction("raw")} AS direction, {q.rule("cleaned")} AS rule FROM ec),
es AS (SELECT event_id, ts, cleaned, coalesce(direction, rule) AS category,
  CASE WHEN direction IS NOT NULL THEN 'direction' WHEN rule IS NOT NULL THEN 'rules' END AS source,
  CAST(CASE WHEN direction IS NOT NULL THEN 0.99 WHEN rule IS NOT NULL THEN 0.98 END AS DOUBLE) AS confidence FROM er)"""


@query("x1_stream_classify", q.with_(EVENT_CTE) + """
SELECT event_id, cleaned, category, source, category IS NULL AS flagged_for_review FROM es""")
def x1_stream_classify(spark, sf):
    stream = event_stream(spark, sf).withColumn("description", event_text())
    out = classify_stream(stream).select("event_id", "cleaned", "category", "source", "flagged_for_review")
    return run_stream(out, "append")


@query("x2_monitor", q.with_(EVENT_CTE) + """
SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS window_start, source, count(*) AS n, round(avg(confidence), 6) AS mean_confidence,
  round(avg(CAST(category IS NULL AS INT)), 6) AS flag_rate FROM es GROUP BY ALL""")
def x2_monitor(spark, sf):
    rows = classify_stream(event_stream(spark, sf).withColumn("description", event_text()))
    out = run_stream(monitor(rows), "complete")
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "source", "n",
        F.round("mean_confidence", 6).alias("mean_confidence"), F.round("flag_rate", 6).alias("flag_rate"),
    )


@query("x3_correction_table", q.with_(LOG) + " SELECT description, predicted_category, correct_category FROM latest")
def x3_correction_table(spark, sf):
    """A stream of corrections, then one of its own that starts anew and delivers all of them late, once more."""
    from spendlens.sources.tables import read_version

    root = f"{shared_folder(spark)}/spendlens-corrections-{uuid.uuid4().hex}"
    for run in ("first", "again"):
        log = correction_log(spark, sf, event_stream(spark, sf)).select("description", "predicted_category", "correct_category", "event_id")
        writer = correction_sink(log, root, order="event_id").option("checkpointLocation", f"{root}/checkpoint-{run}")
        writer.trigger(availableNow=True).start().awaitTermination()
    return read_version(spark, root, "corrections").select("description", "predicted_category", "correct_category")


@query("x1_stream_cascade", recursive(*FULL_SEARCH) + "," + CASCADE)
def x1_stream_cascade(spark, sf):
    """The whole cascade over a stream of transactions: the rows of the batch form."""
    root = f"{shared_folder(spark)}/spendlens-cascade-{uuid.uuid4().hex}"
    rows = txn(spark, sf).select("txn_key", "raw")
    rows.repartition(2).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    settings = {"text": "raw", "kb": full_knowledge(spark, sf), "scorer": "overlap", "encoder": Letters()}
    writer = classify_batches(stream, batch_folders(f"{root}/out"), **settings)
    writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{root}/out")
    return found.groupBy("category", "source", "flagged_for_review").agg(F.count("*").alias("n"))


@query("x4_drop_repeats", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, event_id // 2 AS pair FROM events) GROUP BY ALL")
def x4_drop_repeats(spark, sf):
    stream = event_stream(spark, sf).withColumn("pair", F.floor(F.col("event_id") / 2))
    out = drop_repeats(stream, ["user_id", "event_type", "pair"], watermark="400 days")
    return run_stream(out.select("user_id", "event_type"), "append").groupBy("user_id", "event_type").agg(
        F.count("*").alias("n")
    )
