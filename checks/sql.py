"""The same inputs and expressions as SQL text for the comparison engine."""

from __future__ import annotations

from checks.views import LABELS, TRUE_LABELS
from spendlens import fixed
from spendlens.functions.rules import default_rules, in_order
from spendlens.functions.terms import accent_table
from spendlens.functions.white import WHITE


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(col: str) -> str:
    return f"trim({col}, {lit(WHITE)})"


def folded(col: str) -> str:
    return f"upper(regexp_replace({strip(f"coalesce({col}, '')")}, 'ß', 'ss', 'g'))"


def clean(col: str) -> str:
    text = folded(col)
    chain = text
    for pattern, replacement in fixed.CLEAN_STEPS:
        chain = f"regexp_replace({chain}, {lit(pattern)}, {lit(replacement)}, 'g')"
    whens = " ".join(
        f"WHEN regexp_matches({text}, {lit(p)}) THEN {lit(m)}" for p, m in fixed.CLEAN_MARKERS
    )
    return f"(CASE {whens} ELSE {strip(chain)} END)"


def direction(col: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({folded(col)}, {lit(p)}) THEN {lit(c)}" for p, c in fixed.DIRECTION_PATTERNS
    )
    return f"(CASE {whens} END)"


def rule(col: str, out: str = "category") -> str:
    whens = []
    for r in in_order(default_rules()):
        if r.kind == "contains":
            test = f"contains(upper({col}), {lit(r.pattern.upper())})"
        elif r.kind == "exact":
            test = f"upper({col}) = {lit(r.pattern.upper())}"
        else:
            test = f"regexp_matches(upper({col}), {lit('(?i)' + r.pattern)})"
        whens.append(f"WHEN {test} THEN {lit(r.category if out == 'category' else r.pattern)}")
    return f"(CASE {' '.join(whens)} END)"


def drop_last(col: str) -> str:
    return f"regexp_extract({col}, '^(.*\\S)\\s+\\S+$', 1)"


def fold_accents(col: str) -> str:
    source, target = accent_table()
    return f"translate(lower({col}), {lit(source)}, {lit(target)})"


def case_map(col: str, mapping: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {col} {whens} ELSE {default} END)"


TXN = """
txn AS (
  SELECT l_orderkey * 10 + l_linenumber AS txn_key,
         CASE CAST(l_orderkey % 12 AS INT)
           WHEN 0 THEN 'POS PURCHASE - ' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0') || ' ' || upper(p_name) || ' OTTAWA ON'
           WHEN 1 THEN 'Visa Debit purchase - ' || CAST(1000 + l_suppkey AS VARCHAR) || ' ' || p_name
           WHEN 2 THEN upper(p_name) || ' #' || CAST(l_partkey AS VARCHAR) || ' KANATA ON'
           WHEN 3 THEN 'SQ *' || upper(p_name) || ' NEPEAN ON'
           WHEN 4 THEN 'INTERAC E-TRANSFER TO ' || upper(p_name)
           WHEN 5 THEN 'Payroll Deposit ' || p_name
           WHEN 6 THEN 'REFUND - ' || upper(p_name) || ' TORONTO ON'
           WHEN 7 THEN upper(p_name) || ' PHARMACY'
           WHEN 8 THEN upper(p_name) || ' GAS W' || CAST(l_suppkey AS VARCHAR)
           WHEN 9 THEN 'TST-' || upper(p_name) || ' HALIFAX NS CA'
           WHEN 10 THEN 'MORTGAGE PAYMENT'
           ELSE upper(p_name) || ' WEB SERVICES'
         END AS raw,
         l_extendedprice AS amount,
         CASE WHEN l_returnflag = 'A' THEN 'mastercard' ELSE 'chequing' END AS account_type,
         l_shipdate AS posted_at,
         p_type
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

PLACE = f"""
place AS (
  SELECT p_partkey AS position, p_name AS name,
         CASE WHEN p_size % 5 = 0 THEN 'US' ELSE 'CA' END AS country,
         CASE WHEN p_size % 4 <> 0 THEN 'City' || CAST(p_size AS VARCHAR) END AS locality,
         CASE WHEN p_size % 3 = 0 THEN 'ON' ELSE 'QC' END AS region,
         {case_map("p_type", LABELS, "''")} AS labels
  FROM part
),
canada AS (SELECT * FROM place WHERE country = 'CA')"""

SEEDS = """
seeds AS (
  SELECT s_suppkey AS position,
         'Supplier House ' || translate(right(s_name, 2), '0123456789', 'ABCDEFGHIJ') AS canonical_name,
         s_name AS alias1, 'TST-House ' || CAST(s_nationkey AS VARCHAR) AS alias2,
         CASE WHEN s_nationkey % 2 = 0 THEN 'Shopping & Retail' END AS mapped_category
  FROM supplier
)"""

# Texts are cleaned once per distinct raw text.
CLEANED = f"""
raw_clean AS MATERIALIZED (SELECT raw, {clean("raw")} AS cleaned FROM (SELECT DISTINCT raw FROM txn)),
ruled AS MATERIALIZED (
  SELECT raw, cleaned, {direction("raw")} AS direction, {rule("cleaned")} AS rule,
         {rule("cleaned", "pattern")} AS rule_pattern
  FROM raw_clean
)"""

CATEGORY_LIST = "[" + ", ".join(lit(c) for c in fixed.CATEGORIES) + "]"

JUDGED = f"""
judged AS MATERIALIZED (
  SELECT *, (source = 'sgd' AND confidence < 0.70) AS flagged_for_review FROM (
    SELECT t.txn_key, t.raw, r.cleaned, t.amount, t.account_type, t.posted_at, t.p_type,
           coalesce(direction, rule, {CATEGORY_LIST}[CAST(CAST(round(amount * 100) AS BIGINT) % 10 AS INT) + 1]) AS category,
           CAST(CASE WHEN direction IS NOT NULL THEN 0.99 WHEN rule IS NOT NULL THEN 0.98
                ELSE round(0.5 + (CAST(round(amount * 100) AS BIGINT) % 50) / 100.0, 2) END AS DOUBLE) AS confidence,
           CASE WHEN direction IS NOT NULL THEN 'direction' WHEN rule IS NOT NULL THEN 'rules' ELSE 'sgd' END AS source,
           CASE WHEN NOT contains(t.raw, 'MORTGAGE') THEN {case_map("p_type", TRUE_LABELS, lit("Financial Services"))} END AS label
    FROM txn t JOIN ruled r ON t.raw = r.raw
  )
)"""

KEYWORDS = "kw(category, word, weight, pos) AS (VALUES " + ", ".join(
    [f"('Transportation', {lit(k)}, 2, 0)" for k in fixed.AUTOMOTIVE_KEYWORDS]
    + [
        f"({lit(c)}, {lit(k)}, {1 if k in fixed.GENERIC_KEYWORDS else 2}, {i + 1})"
        for i, (c, words) in enumerate(fixed.LABEL_KEYWORDS.items())
        for k in words
    ]
) + ")"


def label_map(source: str, prefix: str = "") -> str:
    """CTEs mapping the distinct |-joined `labels` of a relation: <prefix>label_map(labels, category, confidence)."""
    p = prefix
    return f"""
{p}lists AS (SELECT DISTINCT labels FROM {source}),
{p}exploded AS (
  SELECT labels, i AS pos, upper(string_split(labels, '|')[CAST(i AS INT)]) AS lab
  FROM {p}lists, LATERAL (SELECT unnest(generate_series(1, len(string_split(labels, '|')))) AS i) WHERE labels <> ''
),
{p}hits AS (
  SELECT labels, category, CAST(sum((10 + length(lab) - length(replace(lab, '>', ''))) * weight) AS BIGINT) AS score,
         min(e.pos * 1000 + kw.pos) AS ord
  FROM {p}exploded e JOIN kw ON contains(lab, word) GROUP BY ALL
),
{p}label_map AS MATERIALIZED (
  SELECT l.labels,
         CASE WHEN max(score) / sum(score) >= 0.40 THEN arg_max(category, score * 1000000 - ord) END AS category,
         coalesce(max(score) / sum(score), 0.0) AS confidence
  FROM {p}lists l LEFT JOIN {p}hits h ON l.labels = h.labels GROUP BY l.labels
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def metadata(labels: str, locality: str, region: str, country: str) -> str:
    """Metadata text of |-joined labels."""
    return (
        f"concat_ws('. ', CASE WHEN {labels} <> '' THEN 'place types: ' || "
        f"array_to_string(string_split({labels}, '|')[1:3], '; ') END, "
        f"'location: ' || concat_ws(', ', {locality}, {region}, {country}))"
    )
