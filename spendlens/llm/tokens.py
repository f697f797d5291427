"""Token ids of texts by a public byte-level BPE file, vectorised over many texts.

A byte-level BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens in a row. Pre-tokens
of texts in ASCII and Latin-1 letters are cut with numpy and looked up by hash and length in a table of those
seen before; new ones are encoded once. Texts with other characters or a special token's string go to the
tokenizer itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from spendlens.llm.words import BLOCK, hashed, utf8

SLOTS = 1 << 19  # pre-tokens remembered per worker: a newer one takes the slot of an older one
WIDTH = 12  # ids a slot holds; texts with longer pre-tokens go to the tokenizer

_LETTER, _DIGIT, _SPACE, _OTHER, _STRANGE = range(5)
_CLASS = np.full(256, _STRANGE, dtype=np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = _LETTER
_SHORT, _PAIRS = np.frombuffer(b"stmd", np.uint8), {b"r": b"e", b"v": b"e", b"l": b"l"}
_SAFE_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def pre_token_starts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the bytes that start a pre-token, and of the bytes this cannot cut (not ASCII or a Latin-1 letter).

    Letters, digits and other signs form runs that take one space before them; a run of white space leaves its
    last character to what follows; 's 't 're 've 'm 'll 'd stand alone.
    """
    n = len(data)
    kind = _CLASS[data]
    lead = data == 0xC3
    after = np.zeros(n, dtype=bool)
    after[1:] = lead[:-1]
    latin = after & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
    paired = np.zeros(n, dtype=bool)
    paired[:-1] = lead[:-1] & latin[1:]
    kind[latin | paired] = _LETTER
    starts = np.ones(n, dtype=bool)
    starts[1:] = kind[1:] != kind[:-1]
    first = np.zeros(n + 1, dtype=bool)
    first[at] = True
    starts |= first[:n]
    space = kind == _SPACE
    ends = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n]) + 1  # what follows a run of white space
    starts[ends - 1] = True
    starts[ends[data[ends - 1] == 32]] = False
    quote = np.flatnonzero((data[: n - 1] == 39) & starts[: n - 1] & ~first[1:n])
    if len(quote):
        room = np.zeros(n + 3, dtype=bool)
        room[:n] = starts
        one = quote[np.isin(data[quote + 1], _SHORT)]
        room[one + 1] = False
        room[one + 2] = True
        rest = quote[(quote + 2 < n)]
        rest = rest[~first[rest + 2]]
        for a, b in _PAIRS.items():
            two = rest[(data[rest + 1] == a[0]) & (data[rest + 2] == b[0])]
            room[two + 1] = False
            room[two + 3] = True
        starts = room[:n]
    return starts, kind == _STRANGE


def _bytes_of_signs() -> dict[str, int]:
    """The sign a byte-level vocabulary writes for each byte: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """`plain`: the strings of special tokens are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [] if plain else [s.encode() for s in added]
        self.keys = np.zeros(SLOTS, dtype=np.uint64)
        self.sizes = np.full(SLOTS, -1, dtype=np.int32)
        self.counts = np.zeros(SLOTS, dtype=np.uint8)
        self.ids = np.zeros((SLOTS, WIDTH), dtype=np.uint32)
        self.encode = self._quick(path, added)

    def _quick(self, path: str, added: list[str]):
        """Encoder of single pre-tokens: the same merges by rank, where the file's ids are in merge order."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        signs = _bytes_of_signs()
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        order = [model["vocab"][m] for m in merged]
        if order != sorted(order):
            return lambda piece: self.whole(piece.decode("utf-8"))
        ranks = {bytes(signs[c] for c in t): i for t, i in model["vocab"].items() if t not in set(added)}
        coder = tiktoken.Encoding("ranks", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        return lambda piece: coder.encode_ordinary(piece.decode("utf-8"))

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def of(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between the offsets, all in a row, and the count of each text."""
        texts = len(at) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(texts, np.int64)
        starts, strange = pre_token_starts(data, at[:-1])
        begin = np.flatnonzero(starts)
        end = np.append(begin[1:], len(data))
        keys = hashed(data, begin, end)
        sizes = (end - begin).astype(np.int32)
        slots = (keys >> np.uint64(45)).astype(np.int64)
        lead = np.searchsorted(begin, at)
        slow = np.add.reduceat(np.append(strange, False), np.minimum(at[:-1], len(data))) > 0
        slow &= np.diff(at) > 0
        raw = None
        for s in self.special:
            raw = data.tobytes() if raw is None else raw
            pos = raw.find(s)
            while pos >= 0:
                slow[np.searchsorted(at, pos, side="right") - 1] = True
                pos = raw.find(s, pos + 1)
        out_ids, out_counts = [], []
        todo = np.ones(len(begin), dtype=bool)
        for i in np.flatnonzero(slow):
            todo[lead[i] : lead[i + 1]] = False
        counts = np.zeros(len(begin), dtype=np.int64)
        rows = np.zeros((len(begin), WIDTH), dtype=np.uint32)
        long = np.zeros(len(begin), dtype=bool)
        known = (self.keys[slots] == keys) & (self.sizes[slots] == sizes)
        counts[known] = self.counts[slots[known]]
        rows[known] = self.ids[slots[known]]
        new = np.flatnonzero(todo & ~known)
        if len(new):
            _, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            fresh = np.zeros((len(first), WIDTH), dtype=np.uint32)
            count = np.zeros(len(first), dtype=np.int64)
            over = np.zeros(len(first), dtype=bool)
            for j, i in enumerate(new[first]):
                got = self.encode(data[begin[i] : end[i]].tobytes())
                if len(got) > WIDTH:
                    over[j] = True
                else:
                    count[j] = len(got)
                    fresh[j, : len(got)] = got
            counts[new], rows[new], long[new] = count[back], fresh[back], over[back]
            kept = new[first[~over]]
            self.keys[slots[kept]], self.sizes[slots[kept]] = keys[kept], sizes[kept]
            self.counts[slots[kept]], self.ids[slots[kept]] = count[~over], fresh[~over]
        for i in np.unique(np.searchsorted(lead, np.flatnonzero(long), side="right") - 1):
            slow[i] = True
            counts[lead[i] : lead[i + 1]] = 0
        counts[~todo] = 0
        flat = rows[np.arange(WIDTH) < counts[:, None]]
        sums = np.concatenate([[0], np.cumsum(counts)])
        per_text = sums[lead[1:]] - sums[lead[:-1]]
        if not slow.any():
            return flat, per_text
        edge = np.concatenate([[0], np.cumsum(per_text)])
        for i in range(texts):
            if slow[i]:
                got = np.array(self.whole(data[at[i] : at[i + 1]].tobytes().decode("utf-8")), dtype=np.uint32)
            else:
                got = flat[edge[i] : edge[i + 1]]
            out_ids.append(got)
            out_counts.append(len(got))
        return np.concatenate(out_ids), np.array(out_counts, dtype=np.int64)


_loaded: dict[tuple[str, bool], Ids] = {}


def ids_of(path: str, plain: bool = False) -> Ids:
    """The tokenizer of a file, loaded once per worker."""
    if (path, plain) not in _loaded:
        _loaded[path, plain] = Ids(path, plain)
    return _loaded[path, plain]


def token_blocks(
    column: pa.Array, path: str, plain: bool = False
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids in a row, count per text) for a column in blocks of bounded size; null is empty.

    A text longer than a block is encoded in parts, cut before a space between two ASCII letters, where a
    pre-token always starts.
    """
    coder = ids_of(path, plain)
    at, data = utf8(column)
    n, row, size = len(at) - 1, 0, BLOCK // 4
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        piece = data[at[row] : at[last]]
        if len(piece) <= size:
            yield row, last, *coder.of(piece, at[row : last + 1] - at[row])
        else:
            text, pos, found = piece.tobytes().decode("utf-8"), 0, []
            while pos < len(text):
                cut = _SAFE_CUT.search(text, pos + size // 2)
                part = np.frombuffer(text[pos : cut.start() if cut else len(text)].encode(), dtype=np.uint8)
                found.append(coder.of(part, np.array([0, len(part)]))[0] if len(part) <= BLOCK else np.array(
                    coder.whole(part.tobytes().decode("utf-8")), dtype=np.uint32))
                pos = cut.start() if cut else len(text)
            ids = np.concatenate(found)
            yield row, last, ids, np.array([len(ids)])
        row = last
