"""Words of UTF-8 texts and hashes of word runs, vectorised over the bytes of many texts.

A word is a run of ASCII letters, digits and non-ASCII characters; A-Z count as
a-z. All positions are word numbers within a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18  # bytes worked on at once
_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IN_WORD = (
    ((LOWER >= ord("a")) & (LOWER <= ord("z"))) | ((_BYTES >= ord("0")) & (_BYTES <= ord("9"))) | (_BYTES >= 128)
)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if _powers is None:
        inverse = pow(_BASE, -1, 1 << 64)
        up = np.full(BLOCK + 1, _BASE, dtype=np.uint64)
        down = np.full(BLOCK + 1, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    return at.astype(np.int64), np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


@dataclass
class Words:
    """Words of rows first..last (exclusive). `skip` words at the left and `spare` at the right of a part of a
    long text belong to its neighbours; `before` is the number of the part's first word."""

    first: int
    last: int
    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # row of each word, from 0 = first
    hash: np.ndarray
    before: int = 0
    skip: int = 0
    spare: int = 0

    def text(self, a: int, b: int) -> str:
        """Words a to b (exclusive) joined by spaces."""
        return b" ".join(self.low[self.start[i] : self.end[i]].tobytes() for i in range(a, b)).decode("utf-8", "replace")


def _split(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes and word edges; no word crosses one of `starts`."""
    inside = IN_WORD[data]
    left = np.zeros(len(data), dtype=bool)
    left[1:] = inside[:-1]
    left[starts[starts < len(data)]] = False
    right = np.zeros(len(data), dtype=bool)
    right[:-1] = inside[1:]
    right[starts[(starts > 0) & (starts <= len(data))] - 1] = False
    return LOWER[data], np.flatnonzero(inside & ~left), np.flatnonzero(inside & ~right) + 1


def hashed(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _power_tables()
    if len(low) > BLOCK:  # only with a single word longer than a block
        out = np.empty(len(start), dtype=np.uint64)
        for i, (a, b) in enumerate(zip(start, end)):
            total, word = 0, low[a:b].astype(np.uint64) + np.uint64(1)
            for j in range(0, len(word), BLOCK):
                part = (word[j : j + BLOCK] * up[: len(word[j : j + BLOCK])]).sum(dtype=np.uint64)
                total = (total + int(part) * pow(_BASE, j, 1 << 64)) & 0xFFFFFFFFFFFFFFFF
            out[i] = total
        return mixed(out)
    sums = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start])


def _of(first: int, last: int, data: np.ndarray, at: np.ndarray, **part) -> Words:
    low, start, end = _split(data, at[:-1])
    row = np.repeat(np.arange(last - first), np.diff(np.searchsorted(start, at)))
    return Words(first, last, low, start, end, row, hashed(low, start, end), **part)


def word_blocks(column: pa.Array, overlap: int) -> Iterator[Words]:
    """Whole column in blocks of bounded size; texts without words may be in none. A text longer than a block comes in parts that repeat `overlap`
    words of their neighbours on either side."""
    at, data = utf8(column)
    n, row = len(at) - 1, 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, side="right")) - 1)
        piece = data[at[row] : at[last]]
        if len(piece) <= BLOCK:
            yield _of(row, last, piece, at[row : last + 1] - at[row])
        else:
            yield from _long(row, piece, overlap)
        row = last


def _long(row: int, data: np.ndarray, overlap: int) -> Iterator[Words]:
    step = BLOCK // 2
    cuts, pos = [0], 0
    while len(data) - pos > step:
        cut = pos + step
        while cut < len(data) and IN_WORD[data[cut]]:  # not inside a word
            gap = np.flatnonzero(~IN_WORD[data[cut : cut + BLOCK]])
            cut = cut + int(gap[0]) if len(gap) else cut + len(data[cut : cut + BLOCK])
        if cut >= len(data):
            break
        cuts.append(cut)
        pos = cut
    cuts.append(len(data))
    before = 0
    for i in range(len(cuts) - 1):
        own = int(len(_split(data[cuts[i] : cuts[i + 1]], np.zeros(1, np.int64))[1]))
        a, skip, b, spare = cuts[i], 0, cuts[i + 1], 0
        j = i
        while j > 0 and skip < overlap:  # words of the parts before
            j -= 1
            _, start, _ = _split(data[cuts[j] : a], np.zeros(1, np.int64))
            take = min(overlap - skip, len(start))
            if take:
                skip, a = skip + take, cuts[j] + int(start[len(start) - take])
            else:
                a = cuts[j]
        j = i + 1
        while j < len(cuts) - 1 and spare < overlap:
            _, _, end = _split(data[b : cuts[j + 1]], np.zeros(1, np.int64))
            take = min(overlap - spare, len(end))
            spare, b = spare + take, b + int(end[take - 1]) if take == overlap - spare and take else cuts[j + 1]
            j += 1
        if own:
            part = data[a:b]
            yield _of(row, row + 1, part, np.array([0, len(part)]), before=before - skip, skip=skip, spare=spare)
        before += own


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they lie in one text."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    out = words.hash[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += words.hash[j : j + n]
    return mixed(out), words.row[:n] == words.row[k - 1 :]
