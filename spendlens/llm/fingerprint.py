"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Triplets are a byte and the two at set distances before it, far enough apart to reach over a syllable, so that
texts of one language do not all fill the same buckets. Each is hashed to one of `BUCKETS` buckets. The digest
holds a checksum byte, the length on a log scale, the quartile ratios, and two bits per bucket: the quartile its
count falls in. The difference of two digests is bounded, so likeness is one minus its share of the bound.
"""

from __future__ import annotations

import hashlib
import json
import math
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.registry import query, table


BUCKETS = 1024
WINDOW = 14
_PAIRS = ((4, 8), (5, 11), (6, 13))  # distances back from the window's last byte
_STEP = np.uint32(0x9E3779B1)
LENGTH_WEIGHT, RATIO_WEIGHT, OUTER = 12, 4, 6
BLOCK = 1 << 18
SPLITS_SAMPLED = 64  # sampled ids per range when cut points are chosen
_DISTANCE = np.array([[0, 1, 2, OUTER], [1, 0, 1, 2], [2, 1, 0, 1], [OUTER, 2, 1, 0]], dtype=np.int64)
MOST = BUCKETS * OUTER


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of hashed triplets; of texts shorter than the least reach there are none."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(data), BLOCK):
        lead = min(at, WINDOW - 1)
        part = np.frombuffer(data, dtype=np.uint8, count=min(len(data) - at, BLOCK) + lead, offset=at - lead)
        byte = part.astype(np.uint32)
        for salt, (a, b) in enumerate(_PAIRS):
            far = max(a, b)
            start = max(far, lead)
            if len(byte) <= start:
                continue
            mixed = byte[start:] | byte[start - a : len(byte) - a] << np.uint32(8)
            mixed |= byte[start - b : len(byte) - b] << np.uint32(16)
            mixed |= np.uint32(salt << 24)
            mixed *= _STEP
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA77)
            counts += np.bincount(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return counts


def digest(data: bytes) -> str:
    """Checksum (2 hex digits), length (2), quartile ratios (2), bucket quartiles (2 bits each)."""
    counts = bucket_counts(data)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * i // 4 - 1]) for i in (1, 2, 3))
    length = min(255, int(round(16 * np.log2(len(data) + 1)))) if data else 0
    ratio = (q1 * 15 // q3) << 4 | (q2 * 15 // q3) if q3 else 0
    code = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8)
    packed = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    return f"{zlib.crc32(data) & 255:02x}{length:02x}{ratio:02x}{packed.tobytes().hex()}"


def _codes(text: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(text[6:]), dtype=np.uint8)
    return np.stack([packed & 3, packed >> 2 & 3, packed >> 4 & 3, packed >> 6], axis=1).ravel()


def difference(one: str, two: str) -> int:
    """0 for equal digests, at most MOST."""
    if one == two:
        return 0
    a, b = bytes.fromhex(one[:6]), bytes.fromhex(two[:6])
    score = int(_DISTANCE[_codes(one), _codes(two)].sum())
    score += LENGTH_WEIGHT * max(0, abs(a[1] - b[1]) - 1) // 16
    score += RATIO_WEIGHT * (max(0, abs((a[2] >> 4) - (b[2] >> 4)) - 1) + max(0, abs((a[2] & 15) - (b[2] & 15)) - 1))
    return min(MOST, score + (a[0] != b[0]))


#: Two bits per bucket that are drawn at random differ by this on average: no likeness at all.
CHANCE = BUCKETS * float(_DISTANCE.mean())


def likeness(one: str, two: str) -> float:
    """1 for equal digests; 0 where they differ as much as digests of unrelated noise do, or more."""
    return max(0.0, 1.0 - difference(one, two) / CHANCE)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many (or all) of the next text's first."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)
_OUT_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _row(doc_id: int | None, text: str, mark: str, following: str, next_mark: str) -> dict:
    changed = edited(text, following)
    raw = changed.encode()
    changed_mark = mark if changed == text else digest(raw)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(raw).hexdigest(),
        "fingerprint": mark,
        "edited_fingerprint": changed_mark,
        "near_edited": likeness(mark, changed_mark),
        "near_next": likeness(mark, next_mark),
    }


def _chained(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Rows of a range in order; each is ended by the first row of the next range (`guest`)."""
    held: tuple | None = None
    for batch in batches:
        rows = []
        for bucket, doc_id, text, guest in zip(*(c.to_pylist() for c in batch.columns)):
            now = (bucket, doc_id, text, digest(text.encode()))
            if held is not None and held[0] == bucket:
                rows.append(_row(held[1], held[2], held[3], now[2], now[3]))
            held = None if guest else now
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _OUT_ARROW)


def _range_of(value: Column, tie: Column, splits: list[tuple[int, int]]) -> Column:
    """Number of split points at or before (value, tie), by groups of points first, then inside one group."""
    if not splits:
        return F.lit(0)
    size = math.isqrt(len(splits)) + 1
    groups = [[{"i": i, "t": t} for i, t in splits[at : at + size]] for at in range(0, len(splits), size)]
    points = F.from_json(F.lit(json.dumps(groups)), "array<array<struct<i: bigint, t: bigint>>>")

    def passed(p: Column) -> Column:
        return (p["i"] < value) | ((p["i"] == value) & (p["t"] <= tie))

    group = F.size(F.filter(points, lambda g: passed(g[0])))
    inner = F.size(F.filter(F.element_at(points, F.greatest(group, F.lit(1))), passed))
    return F.when(group == 0, 0).otherwise((group - 1) * size + inner)


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likeness to it and to the next document.

    Order: doc_id, nulls first, then a hash of the text, then the text; after the last document comes the first.
    Null texts are empty. A lone document is its own next. Texts are shuffled once, to ranges of the order; the
    first row of each range is sent to the range before it as well.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(words).alias("tie"),
        words.alias("text"),
    )
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = F.xxhash64("key", "tie")
    sampled = rows.select("key", "tie").orderBy(spread, "key", "tie").limit(ranges * SPLITS_SAMPLED)
    points = sorted((r[0], r[1]) for r in sampled.toLocalIterator())
    if not points:
        return rows.select("doc_id").mapInArrow(lambda batches: iter(()), _OUT)
    splits = sorted({points[len(points) * i // ranges] for i in range(1, ranges)})
    ranged = rows.withColumn("bucket", _range_of(F.col("key"), F.col("tie"), splits))
    # Least row of each range, and the range before it in the ring of those that have rows.
    firsts = {r[0]: (r[1], r[2]) for r in ranged.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("m")).select(
        "bucket", "m.key", "m.tie").toLocalIterator()}
    used = sorted(firsts)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    places = spark.createDataFrame(
        [(b, *firsts[b], before[b]) for b in used], "bucket int, first_key long, first_tie long, before int"
    )
    first = F.struct("key", "tie", "text", "doc_id")
    heads = ranged.join(
        F.broadcast(places),
        (ranged["bucket"] == places["bucket"]) & (ranged["key"] == places["first_key"]) & (ranged["tie"] == places["first_tie"]),
    ).groupBy("before").agg(F.min(first).alias("m"))
    guests = heads.select(F.col("before").alias("bucket"), "m.*", F.lit(True).alias("guest"))
    both = ranged.withColumn("guest", F.lit(False)).unionByName(guests)
    ordered = both.repartition(ranges, "bucket").sortWithinPartitions("bucket", "guest", "key", "tie", "text")
    return ordered.select("bucket", "doc_id", "text", "guest").mapInArrow(_chained, _OUT)


@query("op3_quartile_fingerprints")
def op3_quartile_fingerprints(spark, sf):
    return fingerprint_pairs(table(spark, sf, "documents"))
