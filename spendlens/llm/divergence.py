"""Divergence of sources from each other by their words, with exact whole numbers.

Of each language the terms of enough documents are kept. A group is a language's source; its rate of a kept term is
1 + floor(SCALE * (count + 1) / (all its counts + kept terms)), and the divergence of rate p from rate q is
floor((p - q)^2 / q). Between two groups it is summed over all kept terms.

The sums are row products in the manner of Gustavson: a task holds a slice of the term-major index (per term the
groups that have it), and each group scatters its terms through that slice into one dense accumulator over its
peers. No pair of postings is written. Terms that one or both groups lack have the group's rate of a count of
zero; that baseline is summed from each group's histogram of rates, and what the scatter adds is corrected by it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.registry import query, table
from spendlens.session import cut_lineage

SCALE_STEPS = 3  # SCALE is 1000 to this power
LEAST_DOCS = 3
TOP_TERMS = 200
ENTRIES = 200_000  # counted terms, or cells of accumulators, that a task holds before it passes them on
PART = 1 << 20  # bytes of a text split at once
GATHERED = 1 << 18  # postings that a group scatters at once

_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)  # A-Z as a-z, all that is no letter as a space


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in lists of bounded size; no term is cut."""
    plain, at = text.translate(_WORD), 0
    while len(plain) - at > PART:
        cut = plain.find(b" ", at + PART)
        if cut < 0:
            break
        yield plain[at:cut].split()
        at = cut
    yield plain[at:].split()


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Counts and documents per lang, source and term, added up as far as ENTRIES allow; a row without a term
    for every group."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *(docs[t] for t in n)], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        counts.clear()

    for batch in batches:
        for text, lang, source in zip(*(batch.column(i) for i in range(3))):
            n, docs = counts.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in _words(text.as_py()):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            if len(n) > ENTRIES or len(counts) > ENTRIES:
                yield from flush()
        if sum(len(n) for n, _ in counts.values()) > ENTRIES:
            yield from flush()
    yield from flush()


def _rate(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)) in digits of 1000, so that no product leaves 64 bits."""
    whole, rest, digits = f"({total} + {terms})", f"({n} + 1)", "0"
    for _ in range(SCALE_STEPS):
        digits = f"({digits} * 1000 + ({rest} * 1000) div {whole})"
        rest = f"(({rest} * 1000) % {whole})"
    return F.expr(f"CASE WHEN {whole} = 0 THEN 1 ELSE 1 + {digits} END").cast("long")


def term_rates(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS
) -> tuple[DataFrame, DataFrame]:
    """(rates, groups). Rates: lang, source, at, term, n, p, zero, q for each kept term that the group has; q is the
    language's rate. Groups: lang, source, at (from 0 in a language by source), terms, n, zero (rate of a count
    of zero).

    Null texts, langs and sources count as empty. Groups without kept terms are in `groups` alone. Repeated
    rows are documents of their own. An empty table gives none.
    """
    given = docs.select(
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
    )
    parts = given.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    counts = cut_lineage(
        parts.withColumn("term", F.col("term").cast("string"))
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    kept = (
        counts.where("term is not null")
        .groupBy("lang", "term")
        .agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least_docs)
        .drop("docs")
    )
    cells = cut_lineage(counts.where("term is not null").drop("docs").join(kept, ["lang", "term"]))
    langs = cells.groupBy("lang", "term").agg(F.first("all_n").alias("n")).groupBy("lang")
    langs = langs.agg(F.count("*").alias("terms"), F.sum("n").alias("lang_n"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").na.fill(0, ["n", "terms", "lang_n"])
    order = Window.partitionBy("lang").orderBy("source")
    groups = cut_lineage(
        groups.withColumn("at", F.row_number().over(order) - 1).withColumn("zero", _rate("0", "n", "terms"))
    )
    own = groups.select("lang", "source", "at", "zero", "terms", "lang_n", F.col("n").alias("group_n"))
    rates = cells.join(own, ["lang", "source"]).select(
        "lang",
        "source",
        "at",
        "term",
        "n",
        _rate("n", "group_n", "terms").alias("p"),
        "zero",
        _rate("all_n", "lang_n", "terms").alias("q"),
    )
    return cut_lineage(rates), groups


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


_PARTS = "lang string, one int, two int, value long"


def _cells(lang: str, rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Cells of a language's accumulators that are not zero."""
    found = {one: np.flatnonzero(row) for one, row in rows.items()}
    ones = np.concatenate([np.full(len(two), one, dtype=np.int32) for one, two in found.items()])
    value = np.concatenate([rows[one][two] for one, two in found.items()])
    twos = np.concatenate(list(found.values())).astype(np.int32)
    names = pa.array([lang] * len(ones), pa.string())
    return pa.RecordBatch.from_arrays(
        [names, pa.array(ones), pa.array(twos), pa.array(value)], names=["lang", "one", "two", "value"]
    )


def _scattered(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Over the terms that both groups have: divergence, less what the baseline counts for them."""
    sums: dict[str, dict[int, np.ndarray]] = {}
    for batch in batches:
        for lang in batch.column(0).unique().to_pylist():
            index = batch.column(1).filter(pc.equal(batch.column(0), lang))
            edge = np.append(0, np.cumsum(index.value_lengths().to_numpy()))
            at, p, zero = (index.flatten().field(i).to_numpy() for i in range(3))
            term = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            by_group = np.argsort(at, kind="stable")
            bounds = np.append(np.flatnonzero(np.append(True, np.diff(at[by_group]) > 0)), len(at))
            rows, width = sums.setdefault(lang, {}), int(at.max()) + 1
            for a, b in zip(bounds[:-1], bounds[1:]):
                mine = by_group[a:b]
                one = int(at[mine[0]])
                row = rows.get(one, np.zeros(0, dtype=np.int64))
                if len(row) < width:
                    row = rows[one] = np.append(row, np.zeros(width - len(row), dtype=np.int64))
                reach = np.cumsum(np.diff(edge)[term[mine]])
                done = 0
                while done < len(mine):
                    before = reach[done - 1] if done else 0
                    last = max(done + 1, int(np.searchsorted(reach, before + GATHERED, side="right")))
                    some = mine[done:last]
                    sizes = np.diff(edge)[term[some]]
                    steps = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    peer = np.repeat(edge[term[some]], sizes) + steps
                    own, none = np.repeat(p[some], sizes), zero[some[0]]
                    value = _apart(own, p[peer]) - _apart(own, zero[peer])
                    value += _apart(none, zero[peer]) - _apart(none, p[peer])
                    np.add.at(row, at[peer], value)
                    done = last
            if sum(len(r) for r in rows.values()) > ENTRIES:
                yield _cells(lang, sums.pop(lang))
    for lang, rows in sums.items():
        yield _cells(lang, rows)


def _baselines(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Sums over all kept terms as if no term were in both groups: one part from either group's histogram."""
    for batch in batches:
        for lang, at, zero, terms, histogram, peers in zip(*(batch.column(i).to_pylist() for i in range(6))):
            peer_zero = np.array([x["zero"] for x in peers], dtype=np.int64)
            peer_at = np.array([x["at"] for x in peers], dtype=np.int64)
            none = _apart(np.int64(zero), peer_zero)
            there = terms * none
            back = np.zeros_like(there)
            for x in histogram or []:
                there += x["times"] * (_apart(np.int64(x["p"]), peer_zero) - none)
                back += x["times"] * (_apart(peer_zero, np.int64(x["p"])) - _apart(peer_zero, np.int64(zero)))
            size = int(peer_at.max()) + 1
            row = np.zeros(size, dtype=np.int64)
            row[peer_at] = there
            yield _cells(lang, {at: row})
            columns = [np.full(len(back), at, dtype=np.int32), back]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(back), pa.string()), pa.array(peer_at.astype(np.int32)), *map(pa.array, columns)],
                names=["lang", "one", "two", "value"],
            )


def pair_divergence(rates: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the lang), value: the divergence over all kept terms.

    An index row has one entry per group of its language, a group's histogram one per different rate, and a row
    of peers one per group: all far below the rows of the result, which are the square of the groups.
    """
    posting = F.struct("at", "p", "zero")
    index = rates.groupBy("lang", "term").agg(F.collect_list(posting).alias("postings")).drop("term")
    shared = index.select("lang", "postings").mapInArrow(_scattered, _PARTS)
    times = rates.groupBy("lang", "at", "p").agg(F.count("*").alias("times"))
    histograms = times.groupBy("lang", "at").agg(F.collect_list(F.struct("p", "times")).alias("histogram"))
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("at", "zero")).alias("peers"))
    own = groups.join(histograms, ["lang", "at"], "left").join(peers, "lang")
    base = own.select("lang", "at", "zero", "terms", "histogram", "peers").mapInArrow(_baselines, _PARTS)
    sums = shared.union(base).where("one != two").groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    name = groups.select("lang", F.col("at").alias("one"), "source")
    other = groups.select("lang", F.col("at").alias("two"), F.col("source").alias("item"))
    every = name.join(other, "lang").where("one != two")
    found = every.join(sums, ["lang", "one", "two"], "left")
    return found.select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def term_divergence(rates: DataFrame) -> DataFrame:
    """lang, source, item (each term that the group uses more than its language), value."""
    value = F.expr("(p - q) * (p - q) div q")
    return rates.where("p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))


def audit(docs: DataFrame, top: int = TOP_TERMS, **columns) -> DataFrame:
    """lang, source, part, item, value, rank: every other source by its divergence, and the first `top` terms.

    Ties rank by the item's UTF-8 bytes. Nulls, empty tables and groups without terms are as in `term_rates`.
    """
    rates, groups = term_rates(docs, **columns)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair_divergence(rates, groups).select("*", F.lit("pair").alias("part"), rank)
    terms = term_divergence(rates).select("*", F.lit("term").alias("part"), rank).where(F.col("rank") <= top)
    return pairs.select(*columns).union(terms.select(*columns))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT id, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM u GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
tot AS (SELECT lang, source, sum(n) AS n FROM cell GROUP BY ALL),
r AS (SELECT cell.lang, cell.source, term, cell.n,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (cell.n + 1) // (tot.n + v.v) AS BIGINT) AS p,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (cell.lang_n + 1) // (v.n + v.v) AS BIGINT) AS q
  FROM cell JOIN tot ON cell.lang = tot.lang AND cell.source = tot.source JOIN v ON cell.lang = v.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM r WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query("op11_source_divergence", SQL)
def op11_source_divergence(spark, sf):
    return audit(table(spark, sf, "documents"))
