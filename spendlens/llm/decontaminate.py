"""Benchmark decontamination by winnowing.

A window of L words (10, or all words of a shorter item) has L - k + 1 grams of
k = min(5, L) words. The least gram hash of every window is a fingerprint, on
both sides, so any shared window shares one. Fingerprints are joined by hash and
each hit is extended to the whole window, word by word.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.files import fresh
from spendlens.llm.registry import query, table
from spendlens.llm.words import grams, mixed, word_blocks
from spendlens.session import cut_lineage

WINDOW = 10
GRAM = 5
FILTER_BITS = 1 << 22  # fixed size of the filter that is broadcast, whatever the benchmark's size

_ITEMS = "item_id long, length int, window string, shift int, fingerprint long"
_TEXTS = (
    "doc_id long, copy long, n_words long,"
    " marks array<struct<fingerprint: bigint, length: int, at: bigint, from: bigint, near: array<string>>>"
)


def _least(values: np.ndarray, ok: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value of every run of w values, and whether all of them are ok."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0], ok[:0]
    least, good = values[:n].copy(), ok[:n].copy()
    for j in range(1, w):
        np.minimum(least, values[j : j + n], out=least)
        good &= ok[j : j + n]
    return least, good


def _keyed(gram_hash: np.ndarray, length: int) -> np.ndarray:
    return mixed(gram_hash + np.uint64(length))


def _bits(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.uint64(FILTER_BITS)
    return fingerprints % size, (fingerprints >> np.uint64(32)) % size


def _item_windows(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {name: [] for name in ("item_id", "length", "window", "shift", "fingerprint")}
        ids = batch.column(0).to_pylist()
        total = np.zeros(len(ids), dtype=np.int64)
        for words in word_blocks(batch.column(1), 0):
            np.add.at(total, words.row + words.first, 1)
        for words in word_blocks(batch.column(1), WINDOW):
            own = len(words.hash) - words.skip - words.spare
            for length in np.unique(np.minimum(total[words.first : words.last], WINDOW)):
                if not length:
                    continue
                k = min(GRAM, int(length))
                hashes, ok = grams(words, k)
                least, good = _least(hashes, ok, int(length) - k + 1)
                fits = np.minimum(total[words.first + words.row[: len(good)]], WINDOW) == length
                for i in np.flatnonzero(good & fits):
                    if not words.skip <= i < words.skip + own:
                        continue
                    shift = int(np.argmax(hashes[i : i + length - k + 1] == least[i]))
                    out["item_id"].append(ids[words.first + int(words.row[i])])
                    out["length"].append(int(length))
                    out["window"].append(words.text(i, i + int(length)))
                    out["shift"].append(shift)
                    out["fingerprint"].append(int(_keyed(least[i : i + 1], int(length)).view(np.int64)[0]))
        yield pa.RecordBatch.from_pydict(
            out,
            pa.schema(
                [
                    ("item_id", pa.int64()),
                    ("length", pa.int32()),
                    ("window", pa.string()),
                    ("shift", pa.int32()),
                    ("fingerprint", pa.int64()),
                ]
            ),
        )


def _text_marks(lengths: list[int], bits):
    """Word counts, and the fingerprints of each text that the filter lets pass, with the words around them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bits.value, dtype=np.uint8), bitorder="little").astype(bool)
        mark = pa.struct(
            [
                ("fingerprint", pa.int64()),
                ("length", pa.int32()),
                ("at", pa.int64()),
                ("from", pa.int64()),
                ("near", pa.list_(pa.string())),
            ]
        )
        for batch in batches:
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            marks: list[list] = [[] for _ in range(batch.num_rows)]
            for words in word_blocks(batch.column(2), 2 * WINDOW):
                own = slice(words.skip, len(words.hash) - words.spare)
                np.add.at(counts, words.row[own] + words.first, 1)
                heads = np.searchsorted(words.row, np.arange(words.last - words.first + 1))
                for length in lengths:
                    k = min(GRAM, length)
                    w = length - k + 1
                    hashes, ok = grams(words, k)
                    least, good = _least(hashes, ok, w)
                    chosen = np.zeros(len(hashes), dtype=bool)
                    for j in range(w):
                        chosen[j : j + len(least)] |= good & (hashes[j : j + len(least)] == least)
                    chosen[: words.skip] = False
                    chosen[own.stop :] = False
                    at = np.flatnonzero(chosen)
                    keyed = _keyed(hashes[at], length)
                    one, two = _bits(keyed)
                    passed = known[one] & known[two]
                    for i, value in zip(at[passed], keyed[passed].view(np.int64)):
                        row = int(words.row[i])
                        base = words.before - int(heads[row])
                        a, b = max(int(heads[row]), i - w + 1), min(int(heads[row + 1]), i + length)
                        near = words.text(a, b).split(" ")
                        marks[words.first + row].append(
                            {
                                "fingerprint": int(value),
                                "length": length,
                                "at": int(i) + base,
                                "from": int(a) + base,
                                "near": near,
                            }
                        )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts), pa.array(marks, type=pa.list_(mark))],
                names=["doc_id", "copy", "n_words", "marks"],
            )

    return run


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Every window of every item with its fingerprint: item_id, length, window, shift, fingerprint."""
    return items.select(F.col(item_id).cast("long"), F.col(text).cast("string")).mapInArrow(_item_windows, _ITEMS)


def window_hits(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (doc_id, copy, n_words), hits (doc_id, copy, start, length, window) and windows (window, item_id).

    `copy` is a digest of the text, so rows that repeat a doc_id are told apart; exact repeats share their hits.
    Null and wordless texts have no hits. The filter of known fingerprints only saves shuffling: what it lets
    pass is joined, so a full filter changes no result.
    """
    spark = docs.sparkSession
    windows = cut_lineage(benchmark_windows(items))
    filled = windows.select("fingerprint").distinct()
    size = F.lit(FILTER_BITS)
    low = F.pmod(F.expr("fingerprint & 4294967295"), size)  # 2**32 is a multiple of the size
    high = F.pmod(F.shiftrightunsigned("fingerprint", 32), size)
    cells = filled.select(F.explode(F.array(low, high)).alias("bit"))
    cells = cells.groupBy((F.col("bit") / 32).cast("int").alias("cell"))
    bits = np.zeros(FILTER_BITS // 32, dtype=np.int64)
    for cell, value in cells.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))")).toLocalIterator():
        bits[cell] = value
    lengths = sorted(r[0] for r in windows.select("length").distinct().toLocalIterator())
    shared = spark.sparkContext.broadcast(bits.astype(np.uint32).astype("<u4").tobytes())
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text)).alias("copy"),
        F.col(text).cast("string").alias("text"),
    )
    read = cut_lineage(rows.mapInArrow(_text_marks(lengths, shared), _TEXTS))
    marks = read.select("doc_id", "copy", F.explode("marks").alias("m")).select("doc_id", "copy", "m.*")
    kinds = windows.groupBy("fingerprint", "length", "window", "shift").agg(F.lit(1).alias("_one"))
    begin = F.col("at") - F.col("shift")
    inside = F.expr("slice(near, cast(at - shift - from + 1 as int), length)")
    hits = (
        marks.join(kinds.drop("_one"), ["fingerprint", "length"])
        .where(begin >= F.col("from"))
        .where(F.concat_ws(" ", inside) == F.col("window"))
        .select("doc_id", "copy", begin.alias("start"), "length", "window")
        .distinct()
    )
    return read.drop("marks"), hits, windows.select("window", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated, copy.

    Null and empty texts have no words and no hit; rows of one id and different texts are told apart by `copy`,
    repeated rows give equal rows; null item ids are not listed; without items nothing is hit.
    """
    texts, hits, windows = window_hits(docs, items, id_col, text)
    key = ["doc_id", "copy"]
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "length"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, hit: F.struct(
            (
                acc["n"]
                + F.greatest(
                    F.lit(0).cast("long"), hit["start"] + hit["length"] - F.greatest(hit["start"], acc["to"])
                )
            ).alias("n"),
            F.greatest(acc["to"], hit["start"] + hit["length"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )
    spans = hits.groupBy(*key).agg(covered.alias("n_hit"))
    found = hits.select(*key, "window").distinct().join(windows, "window")
    ids = found.where("item_id is not null").groupBy(*key).agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")
    )
    marked = spans.alias("s").join(ids.alias("i"), _same("s", "i"), "left").select("s.*", "i.item_ids")
    out = texts.alias("t").join(marked.alias("m"), _same("t", "m"), "left")
    none = F.array().cast("array<string>")
    return out.select(
        "t.doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("item_ids").cast("long"), F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        F.col("t.copy").alias("copy"),
    )


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.copy") == F.col(f"{b}.copy"))


def without_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without a hit, with all their columns.

    Null texts and texts without words have no hit and stay; repeated rows stay or go together.
    """
    _, hits, _ = window_hits(docs, items, id_col, text)
    bad_id, bad_copy = fresh(docs, "bad_id", "bad_copy")
    bad = hits.select(F.col("doc_id").alias(bad_id), F.col("copy").alias(bad_copy)).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(bad_id)) & (F.xxhash64(F.col(text)) == F.col(bad_copy))
    return docs.join(bad, same, "left_anti")


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
    unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
      lambda i: array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' '))) AS g
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i,
    unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS g
  FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


@query("op1_winnowing_decontamination", SQL)
def op1_winnowing_decontamination(spark, sf):
    found = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")
