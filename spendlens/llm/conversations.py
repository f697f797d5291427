"""Conversation structure repair over a suffix-shared automaton.

A conversation's signature has one sign per row: its role's initial and whether it must go, is cut off or is whole.
Signatures that end alike share states: distinct signatures are dealt out and sorted from their ends, so that a
task walks them as one acyclic automaton and holds only the states of the present one. Each state is worked out once
per grammar state: the least cost to the end and the first edit of the least audit. Edits of one state and grammar
state have different initials, so the first edit settles ties, and no audit is kept but those that are read off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.files import fresh
from spendlens.llm.registry import query, table
from spendlens.session import cut_lineage

DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3  # costs; a kept row costs 0, an undeleted cut-off row CUT_OFF more
GONE = "x"  # sign of a row that must be deleted; other signs are s, u, a or o, in upper case if cut off
ROLES = {"u": "user", "a": "assistant"}
# Grammar (s?(ua)+)? - state: {initial: next state}; the first and the last state may end.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
_FAR = 1 << 60
_WHITE = " \t\n\x0b\f\r"

State = tuple[tuple[int, str], ...]  # per grammar state: cost to the end, first edit


def _insertions(best: list[tuple[int, str]]) -> State:
    """The state with insertions before what comes next: one step to the next role, so two rounds settle it."""
    for _ in range(2):
        best = [
            min([best[g], *((best[to][0] + INSERT, "I") for initial, to in GRAMMAR[g].items() if initial in ROLES)])
            for g in range(len(GRAMMAR))
        ]
    return tuple(best)


END: State = _insertions([(0, "") if g in ENDS else (_FAR, "") for g in range(len(GRAMMAR))])


def state_before(sign: str, after: State) -> State:
    """The state of a suffix that starts with a sign, from the state after it."""
    best = []
    for g, steps in enumerate(GRAMMAR):
        edits = [(after[g][0] + DELETE, "D")]
        if sign != GONE:
            more = CUT_OFF if sign.isupper() else 0
            if sign.lower() in steps:
                edits.append((after[steps[sign.lower()]][0] + more, "K"))
            edits += [(after[to][0] + REROLE + more, "R") for initial, to in steps.items() if initial in ROLES]
        best.append(min(edits))
    return _insertions(best)


def _step(grammar: int, initial: str) -> int:
    return GRAMMAR[grammar][initial]


def _next_role(grammar: int) -> str:
    """The one role, user or assistant, that the grammar lets an insertion or a rerole take."""
    return next(i for i in GRAMMAR[grammar] if i in ROLES)


def audit_of(signature: str, states: list[State]) -> tuple[int, str]:
    """Cost and audit of a signature; states[k] is that of its last k signs."""
    left, grammar, out = len(signature), 0, []
    while True:
        edit = states[left][grammar][1]
        if not edit:
            return states[-1][0][0], "".join(out)
        out.append(edit)
        if edit in "IR":
            grammar = _step(grammar, _next_role(grammar))
        elif edit == "K":
            grammar = _step(grammar, signature[len(signature) - left].lower())
        left -= edit != "I"


def _audited(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Cost and audit of signatures that come in the order of their ends."""
    states, before = [END], ""
    for batch in batches:
        costs, audits = [], []
        for mirrored in batch.column(0).to_pylist():
            common = 0
            for one, two in zip(before, mirrored):
                if one != two:
                    break
                common += 1
            del states[common + 1 :]
            for sign in mirrored[common:]:
                states.append(state_before(sign, states[-1]))
            before = mirrored
            cost, audit = audit_of(mirrored[::-1], states)
            costs.append(cost)
            audits.append(audit)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string())],
            names=["mirrored", "cost", "audit"],
        )


def repairs(signatures: DataFrame) -> DataFrame:
    """mirrored, cost and audit for the column `mirrored` (distinct signatures, last sign first)."""
    dealt = signatures.repartitionByRange("mirrored").sortWithinPartitions("mirrored")
    return dealt.mapInArrow(_audited, "mirrored string, cost long, audit string")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows with damage by crc32(`conv:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes its [.!?], 3
    repeats it, 4 sets its role to user. A null counts as one space, in the key as in role and text."""

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    harm = fresh(rows, "harm")
    key = F.concat(filled(conv), F.lit(":"), filled(turn))
    rows = rows.withColumn(harm, (F.crc32(F.encode(key, "UTF-8")) % 20).cast("int"))
    text = F.when(F.col(harm) == 1, "").when(F.col(harm) == 2, F.regexp_replace(filled("text"), "[.!?]", ""))
    rows = rows.withColumn("text", text.otherwise(filled("text")))
    rows = rows.withColumn("role", F.when(F.col(harm) == 4, "user").otherwise(filled("role")))
    times = F.when(F.col(harm) == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    copy = fresh(rows, "copy")
    return rows.where(F.col(harm) != 0).withColumn(copy, F.explode(times)).drop(harm, copy)


_ORDER = ["turn", "role", "digest"]  # nulls first, as Spark sorts; rows of equal role and text are alike


def _seen(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text and digest of rows; texts are compared by their SHA-256."""
    digest = F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))
    return rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long"), "role", "text", digest.alias("digest"))


def structure(rows: DataFrame) -> DataFrame:
    """One row per conversation of (damaged) rows conv_id, turn, role, text: conv, gaps, blank, duplicate, truncated,
    illegal, mirrored.

    Rows go by turn (nulls first), then role and text. A row's first fault counts. Texts are not shuffled, only
    their digests. Windows stream one sorted conversation at a time and can spill.
    """
    last = F.substring(F.rtrim("text", F.lit(_WHITE)), -1, 1)
    light = _seen(rows).select(
        "conv", "turn", "role", "digest", (last == "").alias("is_blank"), (~last.isin(".", "!", "?")).alias("is_cut")
    )
    order = Window.partitionBy("conv").orderBy(*_ORDER)
    same = Window.partitionBy("conv", "role", "digest").orderBy("at")
    initial = F.substring("role", 1, 1)
    light = light.withColumn("initial", initial).withColumn("at", F.row_number().over(order).cast("long"))
    light = light.withColumn("step", F.concat(F.lag("initial").over(order), "initial"))
    light = light.withColumn("new_turn", F.coalesce(F.col("turn") != F.lag("turn").over(order), F.col("turn").isNotNull()))
    light = light.withColumn("again", F.row_number().over(same) > 1)
    cut = ~F.col("is_blank") & ~F.col("again") & F.col("is_cut")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    sign = F.when(F.col("is_blank") | F.col("again"), GONE).when(cut, F.upper(known)).otherwise(known)

    def total(flag: Column) -> Column:
        return F.sum(flag.cast("long"))

    found = light.groupBy("conv").agg(
        (F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)) - total(F.col("new_turn"))).alias("gaps"),
        total(F.col("is_blank")).alias("blank"),
        total(~F.col("is_blank") & F.col("again")).alias("duplicate"),
        total(cut).alias("truncated"),
        F.coalesce(total(~F.col("step").isin("su", "ua", "au")), F.lit(0).cast("long")).alias("illegal"),
        F.sort_array(F.collect_list(F.struct((-F.col("at")).alias("at"), sign.alias("sign")))).alias("signs"),
    )
    mirrored = F.array_join(F.transform("signs", lambda s: s["sign"]), "")
    return found.withColumn("mirrored", mirrored).drop("signs")


def _repaired(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, digest of the repaired conversation) from rows of one partition: of each conversation first its audit,
    then its rows in order."""
    conv, audit, at, grammar, total, lines = None, None, 0, 0, None, 0

    def put(role: str, text: str) -> None:
        nonlocal lines
        total.update((("\n" if lines else "") + f"{role}:{text}").encode())
        lines += 1

    def insert() -> None:
        nonlocal at, grammar
        while at < len(audit) and audit[at] == "I":
            initial = _next_role(grammar)
            put(ROLES[initial], "")
            at, grammar = at + 1, _step(grammar, initial)

    for this, edits, role, text in rows:
        if edits is not None:
            if total is not None:
                insert()
                yield conv, total.hexdigest()
            conv, audit, at, grammar, total, lines = this, edits, 0, 0, hashlib.sha256(), 0
            continue
        insert()
        edit, at = audit[at], at + 1
        if edit != "D":
            initial = role[:1] if edit == "K" else _next_role(grammar)
            put(role if edit == "K" else ROLES[initial], text)
            grammar = _step(grammar, initial)
    if total is not None:
        insert()
        yield conv, total.hexdigest()


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    kind = None

    def rows() -> Iterator[tuple]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)))

    some: list[tuple] = []
    for found in _repaired(rows()):
        some.append(found)
        if len(some) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], kind), pa.array([d for _, d in some])], names=["conv", "digest"])
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], kind), pa.array([d for _, d in some])], names=["conv", "digest"])


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of `conversations`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256, for (damaged) rows conv_id, turn, role, text without null roles and texts.

    Edits: Keep, Rerole (to user or assistant), Delete, Insert (an empty text of user or assistant). The audit is
    the cheapest sequence of their initials that leaves role initials of (s?(ua)+)?, the ASCII-least of equals;
    blank and duplicate rows are deleted. Conversations without rows have zeros, an empty audit and the hash of
    nothing; a null conv_id is a conversation of its own. Other columns take no part. Empty tables give no rows.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    found = cut_lineage(structure(rows))
    audits = repairs(found.select("mirrored").distinct())
    found = cut_lineage(found.join(audits, "mirrored").drop("mirrored"))
    heads = found.select("conv", F.lit(0).alias("part"), "audit", *[F.lit(None).cast(t).alias(n) for n, t in _BODY])
    body = _seen(rows).select("conv", F.lit(1).alias("part"), F.lit(None).cast("string").alias("audit"), *[n for n, _ in _BODY])
    every = heads.union(body).repartition("conv").sortWithinPartitions("conv", "part", *_ORDER)
    hashes = every.select("conv", "audit", "role", "text").mapInArrow(_hashed, f"conv {kind}, digest string")
    ids = conversations.select("conv_id").distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv").alias("f")
    out = out.join(hashes.alias("h"), F.col("f.conv_id").eqNullSafe(F.col("h.conv")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id",
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


_BODY = [("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string")]


def _sql_edit(state: str, cost: str, initial: str) -> str:
    """A state one edit earlier; SQL states are nine digits of cost, then the audit, so the least string is best."""
    return f"lpad(CAST(CAST(substr({state}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{initial}' || substr({state}, 10)"


def _sql_before(state: str, keeps: dict[str, str], to: str) -> str:
    kept = [f"CASE WHEN sign <> 'x' AND initial = '{i}' THEN {_sql_edit(s, 'more', 'K')} END" for i, s in keeps.items()]
    edits = [_sql_edit(state, "4", "D"), *kept, f"CASE WHEN sign <> 'x' THEN {_sql_edit(to, 'more + 3', 'R')} END"]
    return f"least({', '.join(edits)})"


_SQL_BASE = f"""{_sql_before("s0", {"s": "s1", "u": "s2"}, "s2")} AS b0, {_sql_before("s1", {"u": "s2"}, "s2")} AS b1,
    {_sql_before("s2", {"a": "s3"}, "s3")} AS b2, {_sql_before("s3", {"u": "s2"}, "s2")} AS b3"""
_SQL_INSERT = f"""least(b0, {_sql_edit("t2", "3", "I")}), least(b1, {_sql_edit("t2", "3", "I")}), t2, least(b3, {_sql_edit("b2", "3", "I")})"""
SQL = f"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(16), lambda n: list_reduce(range(4), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(n AS BIGINT))) AS crc),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' ||
      coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda b: CAST('0x' || b AS BIGINT)) AS bytes
  FROM conversations),
harmed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(bytes, lambda a, b:
    xor(
      xor(a >> 4, crc[((xor(a, b) & 15) + 1)::INT]) >> 4,
      crc[((xor(xor(a >> 4, crc[((xor(a, b) & 15) + 1)::INT]), b >> 4) & 15) + 1)::INT]),
    CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS harm
  FROM given, t),
left_over AS (
  SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE harm WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM harmed WHERE harm <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS nth FROM left_over),
faults AS (
  SELECT *, substr(role, 1, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 AS again,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY nth) || substr(role, 1, 1) AS step
  FROM placed),
signs AS (
  SELECT *, CASE WHEN trimmed = '' OR again THEN 'x' WHEN substr(trimmed, -1) NOT IN ('.', '!', '?') THEN 'c' ELSE 'w' END AS sign,
    trimmed = '' AS blank
  FROM faults),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (sign = 'x' AND NOT blank) AS duplicate, count(*) FILTER (sign = 'c') AS truncated,
    count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal, max(nth) AS n
  FROM signs GROUP BY conv_id),
walk AS (
  SELECT conv_id, n AS left_at, '000000000' AS s0, '000000006II' AS s1, '000000003I' AS s2, '000000000' AS s3 FROM counts
  UNION ALL
  SELECT conv_id, left_at - 1, {_SQL_INSERT} FROM (
    SELECT *, least(b2, {_sql_edit("b3", "3", "I")}) AS t2 FROM (
      SELECT w.conv_id, left_at, {_SQL_BASE}
      FROM (SELECT w.*, sign, initial, CASE sign WHEN 'c' THEN 3 ELSE 0 END AS more
        FROM walk w JOIN signs s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND s.nth = w.left_at) w))),
audits AS (SELECT conv_id, CAST(substr(s0, 1, 9) AS BIGINT) AS cost, substr(s0, 10) AS audit FROM walk WHERE left_at = 0),
redo AS (
  SELECT conv_id, audit, 1 AS i, 1 AS nth, 0 AS g, CAST([] AS VARCHAR[]) AS lines FROM audits
  UNION ALL
  SELECT conv_id, audit, i + 1, CASE e WHEN 'I' THEN nth ELSE nth + 1 END,
    CASE WHEN e = 'D' THEN g WHEN e = 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE g WHEN 2 THEN 3 ELSE 2 END END,
    CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
      WHEN 'R' THEN list_append(lines, CASE g WHEN 2 THEN 'assistant:' ELSE 'user:' END || text)
      ELSE list_append(lines, CASE g WHEN 2 THEN 'assistant:' ELSE 'user:' END) END
  FROM (SELECT r.*, substr(audit, i, 1) AS e, s.initial, s.role, s.text
    FROM redo r LEFT JOIN signs s ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND s.nth = r.nth
    WHERE i <= length(audit))),
done AS (SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS digest FROM redo WHERE i = length(audit) + 1)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN counts c ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN audits a ON g.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN done d ON g.conv_id IS NOT DISTINCT FROM d.conv_id
"""


@query("op13_conversation_repair", SQL)
def op13_conversation_repair(spark, sf):
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(given), given)
