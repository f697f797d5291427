"""Best-fit packing into fixed-length sequences by bin completion.

A document of more than `capacity` ids is cut into full pieces, its first piece taking what is left over. Full
pieces fill sequences of their own. What remains is a multiset of lengths below `capacity`: its histogram has
fewer than `capacity` entries however large the corpus, and the search runs on it, giving sequences of equal
make-up as one pattern with a repeat count. Documents then find their places by their rank among pieces of
their length, from per-partition counts and a prefix sum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.registry import query, table
from spendlens.llm.tokens import token_blocks
from spendlens.session import cut_lineage

CAPACITY = 1024
END = 2
CHOICES = 12  # fillings kept per sequence, fullest first
LOOKS = 8  # fillings looked at for each one kept
ROUNDINGS = 24  # fractions of a sequence that the bound rounds lengths to
BACKTRACKS = 2_000  # branches given up over the whole search; the incumbent counts after that
STEPS = 8_000  # sequences completed over the whole search, likewise

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, place long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_PLACED_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


def document_ids(column: pa.Array, path: str, end: int) -> Iterable[tuple[int, np.ndarray]]:
    """(row, ids with the end id) of every text."""
    for first, last, ids, counts in token_blocks(column, path):
        edge = np.concatenate([[0], np.cumsum(counts)])
        for i in range(last - first):
            yield first + i, np.append(ids[edge[i] : edge[i + 1]], np.uint32(end)).astype("<u4")


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)  # pieces of each length so far in this partition
        for batch in batches:
            ids = batch.column(0)
            out: list[list] = [[] for _ in range(6)]
            for row, found in document_ids(batch.column(1), path, end):
                head = len(found) % capacity or min(capacity, len(found))
                edges = [0, *range(head, len(found) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    values = (row, piece, a, b - a, zlib.crc32(found[a:b].tobytes()), int(seen[b - a]))
                    seen[b - a] += 1
                    for column, value in zip(out, values):
                        column.append(value)
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(rows),
                    pa.array(out[1], pa.int32()),
                    pa.array(out[2], pa.int64()),
                    pa.array(out[3], pa.int32()),
                    pa.array(out[4], pa.int64()),
                    pa.array([part] * len(rows), pa.int32()),
                    pa.array(out[5], pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"],
            )

    return run


Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, times), ...), repeats


def _reach(sizes: list[int], counts: np.ndarray, room: int) -> list[int]:
    """Bit sets: entry i has bit s where some of the pieces of sizes[:i] (rising) add up to s, s at most `room`."""
    mask = (1 << (room + 1)) - 1
    sums, levels = 1, [1]
    for size in sizes:
        left, step = min(int(counts[size]), room // size), 1
        while left:
            step = min(step, left)
            sums |= (sums << step * size) & mask
            left -= step
            step *= 2
        levels.append(sums)
    return levels


def _exact(levels: list[int], sizes: list[int], counts: np.ndarray, top: int, s: int):
    """Every filling of sum `s` from sizes[:top], the one with the longest pieces first."""
    if not s:
        yield ()
        return
    for i in range(top - 1, -1, -1):
        if not levels[i + 1] >> s & 1:
            return
        size = sizes[i]
        for n in range(min(int(counts[size]), s // size), 0, -1):
            if levels[i] >> (s - n * size) & 1:
                for rest in _exact(levels, sizes, counts, i, s - n * size):
                    yield (size,) * n + rest


def _stretched(bits: int, span: int) -> int:
    """Every bit set, and the `span` bits above it."""
    done = 0
    while done < span:
        step = min(done + 1, span - done)
        bits |= bits << step
        done += step
    return bits


def _dominated(filling: tuple[int, ...], sizes: list[int], counts: np.ndarray, slack: int) -> bool:
    """Whether a piece left out fits where some pieces of the filling (none, a shorter one, or several) are.

    The filling with that piece instead is at least as good: what it sets free can go where the piece would.
    """
    one, several = 0, 0  # sums of one piece, of two or more
    for size in filling:
        several |= (several | one) << size
        one |= 1 << size
    swaps = _stretched(several | 1, slack)
    if slack:
        swaps |= _stretched(one << 1, slack - 1)
    return any(swaps >> x & 1 and counts[x] > filling.count(x) for x in sizes)


def _fillings(counts: np.ndarray, room: int, best: int) -> list[tuple[int, ...]]:
    """Undominated fillings of `room` by any number of pieces in stock, fullest first, at most `best`.

    Sums that can be reached are worked out for all pieces at once; fillings are read back from them, longest
    pieces first, so that none is built that does not lead to its sum. At most `LOOKS` times `best` are read.
    """
    sizes = [int(s) for s in np.flatnonzero(counts[: room + 1])]
    if not sizes:
        return [()]
    levels = _reach(sizes, counts, room)
    found, looks = [], best * LOOKS if best > 1 else 1
    left = levels[-1]
    while left and looks > 0 and len(found) < best:
        s = left.bit_length() - 1
        left ^= 1 << s
        share = max(1, looks // 2)  # some looks stay for the sums below
        for filling in _exact(levels, sizes, counts, len(sizes), s):
            if best == 1 or not _dominated(filling, sizes, counts, room - s):
                found.append(filling)
            looks, share = looks - 1, share - 1
            if share <= 0 or looks <= 0 or len(found) == best:
                break
    return found


def _repeats(counts: np.ndarray, pattern: list[int]) -> int:
    return int(min(counts[s] // pattern.count(s) for s in set(pattern)))


def _best_fit(counts: np.ndarray, capacity: int) -> tuple[list[Pattern], int]:
    """Best-fit decreasing on the histogram: pieces by falling length, each into the fullest sequence it fits."""
    open_bins: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}  # room -> make-up -> sequences
    for size in np.flatnonzero(counts)[::-1]:
        size, todo = int(size), int(counts[size])
        while todo:
            fits = [room for room in open_bins if room >= size]
            if not fits:
                per = capacity // size
                full, rest = divmod(todo, per)
                for n, times in ((per, full), (rest, 1)):
                    if n and times:
                        group = open_bins.setdefault(capacity - n * size, {})
                        key = ((size, n),)
                        group[key] = group.get(key, 0) + times
                break
            room = min(fits)
            group = open_bins[room]
            make, times = next(iter(group.items()))
            per = min(room // size, todo)
            used = min(times, todo // per)
            if used == times:
                del group[make]
            else:
                group[make] = times - used
            if not group:
                del open_bins[room]
            key = (*make, (size, per))
            other = open_bins.setdefault(room - per * size, {})
            other[key] = other.get(key, 0) + used
            todo -= per * used
    patterns = [(make, times) for group in open_bins.values() for make, times in group.items()]
    return patterns, sum(times for _, times in patterns)


@cache
def _rounded(capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of each length that no full sequence can exceed in sum, and that sum, for several roundings."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    rows, tops = [], []
    for k in range(1, ROUNDINGS + 1):
        whole, rest = np.divmod((k + 1) * sizes, capacity)
        rows.append(np.where(rest == 0, sizes * k, whole * capacity))
        tops.append(k * capacity)
    return np.array(rows), np.array(tops)


def waste_bound(counts: np.ndarray, capacity: int) -> int:
    """Least number of sequences: total length, pieces too long to share with what a split point leaves, or
    lengths rounded to fractions of a sequence."""
    sizes = np.arange(len(counts))
    best = -(-int((counts * sizes).sum()) // capacity)
    over = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    weight = np.concatenate([np.cumsum((counts * sizes)[::-1])[::-1], [0]])
    half = capacity // 2
    k = np.flatnonzero(counts[: half + 1])
    if len(k):
        cut = np.minimum(capacity - k + 1, len(counts))
        alone = over[cut]
        large = over[half + 1] - alone
        room = large * capacity - (weight[half + 1] - weight[cut])
        small = weight[k] - weight[half + 1]
        best = max(best, int((alone + large + np.maximum(0, -(-(small - room) // capacity))).max()))
    rows, tops = _rounded(capacity)
    return max(best, int((-(-(rows[:, : len(counts)] @ counts) // tops)).max()))


def plan_patterns(
    counts: np.ndarray, capacity: int = CAPACITY, backtracks: int = BACKTRACKS, steps: int = STEPS
) -> list[Pattern]:
    """Patterns that use every piece of the histogram (counts[length]) once, in as few sequences as found.

    Branch and bound over completions of the largest piece: each branch takes one undominated filling, as often
    as the stock allows or half as often. Best-fit decreasing is the first incumbent; a branch ends when its
    sequences plus the waste bound of what is left cannot beat the incumbent, and the search when the incumbent
    meets the bound, or after `backtracks` branches given up or `steps` sequences completed.
    """
    counts = np.asarray(counts, dtype=np.int64)
    counts = np.concatenate([counts, np.zeros(max(0, capacity + 1 - len(counts)), dtype=np.int64)])
    if not counts.any():
        return []
    bound = waste_bound(counts, capacity)
    best, least = _best_fit(counts, capacity)
    stack: list[tuple[np.ndarray, tuple | None, int]] = [(counts, None, 0)]  # stock, chain of patterns, sequences
    while stack and least > bound and backtracks > 0 and steps > 0:
        stock, chain, bins = stack.pop()
        if not stock.any():
            if bins < least:
                best, least = [], bins
                while chain:
                    best.append(chain[0])
                    chain = chain[1]
            backtracks -= 1
            continue
        if bins + waste_bound(stock, capacity) >= least:
            backtracks -= 1
            continue
        steps -= 1
        large = int(np.flatnonzero(stock)[-1])
        stock[large] -= 1
        options = _fillings(stock, capacity - large, CHOICES)
        stock[large] += 1
        branches = []
        for filling in options:
            pattern = [large, *filling]
            times = _repeats(stock, pattern)
            branches.append((0, times, pattern))
            if times > 1:
                branches.append((1, times // 2, pattern))
        for _, times, pattern in sorted(branches, key=lambda b: b[0])[::-1]:
            rest = stock.copy()
            make = tuple((s, pattern.count(s)) for s in sorted(set(pattern), reverse=True))
            for s, n in make:
                rest[s] -= n * times
            stack.append((rest, ((make, times), chain), bins + times))
    return best


def _places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank of each run, first sequence, pieces per sequence, and offset inside it."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for make, times in patterns:
        offset = 0
        for size, n in make:
            runs.setdefault(size, []).append((used.get(size, 0), sequence, n, offset))
            used[size] = used.get(size, 0) + n * times
            offset += n * size
        sequence += times
    return {size: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for size, rows in runs.items()}


def _placed(places):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known = places.value
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                first, start, per, base = known[int(size)]
                run = np.searchsorted(first, rank[at], side="right") - 1
                inner = rank[at] - first[run]
                sequence[at] = start[run] + inner // per[run]
                offset[at] = base[run] + inner % per[run] * size
            arrays = [batch.column(i) for i in range(3)]
            arrays += [pa.array(length.astype(np.int64)), batch.column(4), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_PLACED_ARROW)

    return run


def pack_documents(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end: int = END,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one `end` id. Repeated rows are packed each on its own. An empty table gives no
    rows. Broadcast: the places of all patterns, bounded by the number of different lengths.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = cut_lineage(rows.mapInArrow(_pieces(path, capacity, end), _PIECES))
    sizes = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("n")).toLocalIterator():  # one row per length
        counts[length] = n
    places = spark.sparkContext.broadcast(_places(plan_patterns(counts, capacity)))
    ranked = pieces.join(offsets, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank")
    )
    return ranked.mapInArrow(_placed(places), _PLACED)


def packed_sequences(docs: DataFrame, placed: DataFrame, path: str, end: int = END) -> DataFrame:
    """The packed ids themselves: sequence_id, ids. doc_id must be unique here."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for row, found in document_ids(batch.column(1), path, end):
                spots = batch.column(2)[row].as_py()
                yield pa.RecordBatch.from_pydict(
                    {
                        "sequence_id": [s["sequence_id"] for s in spots],
                        "offset": [s["offset"] for s in spots],
                        "ids": [found[s["start"] : s["start"] + s["length"]].astype(np.int64) for s in spots],
                    }
                )

    spots = placed.groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("spots")
    )
    rows = docs.select("doc_id", "text").join(spots, "doc_id")
    parts = rows.mapInArrow(cut, "sequence_id long, offset long, ids array<long>")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf):
    import public_tokenizers

    return pack_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
