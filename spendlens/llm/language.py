"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of signs. An n-gram is bound as the product of its letters' vectors,
each rotated by its place; a text is the bundle (sum) of its n-grams; a language's prototype is the bundle of
its training texts, each scaled to one length. The prediction is the prototype of the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.files import fresh
from spendlens.llm.registry import query, table

DIMENSIONS = 1024
GRAM = 3
BLOCK = 1 << 18  # letters worked on at once
GRAMS = 4096  # n-gram vectors at once
TEXTS = 256
KEPT_LETTERS = 4096  # letter vectors a worker remembers
SCALE = 1 << 20  # unit vectors are summed as whole numbers, so sums do not depend on their order
SPACE = 32
UNKNOWN = "und"

_alpha: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _alpha


class Space:
    """Vectors of letters; each follows from its code point alone. N-grams are bound when they are needed, so a
    worker remembers KEPT_LETTERS vectors at most."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.letter: dict[int, np.ndarray] = {}

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        if len(self.letter) > KEPT_LETTERS:
            self.letter.clear()
        out = np.empty((len(codes), self.dimensions), dtype=np.int8)
        for i, code in enumerate(codes.tolist()):
            if code not in self.letter:
                rng = np.random.Generator(np.random.PCG64([7919, code]))
                self.letter[code] = (rng.integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)
            out[i] = self.letter[code]
        return out

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of the n-grams, one per row of code points."""
        n = grams.shape[1]
        codes, at = np.unique(grams, return_inverse=True)
        at, letters = at.reshape(grams.shape), self.vectors(codes)
        out = letters[at[:, -1]]
        for turn in range(1, n):
            out *= np.roll(letters, turn, axis=1)[at[:, n - 1 - turn]]
        return out.astype(np.float32)


_spaces: dict[int, Space] = {}


def _space(dimensions: int) -> Space:
    if dimensions not in _spaces:
        _spaces[dimensions] = Space(dimensions)
    return _spaces[dimensions]


def _symbols(text: str) -> Iterator[np.ndarray]:
    """Letters in lower case with one space for whatever lies between, before and after them, in parts that
    repeat the last GRAM - 1 symbols of the part before."""
    alpha, tail, open_word = _letters(), np.array([SPACE], dtype=np.uint32), False
    for at in range(0, len(text), BLOCK):
        last = at + BLOCK >= len(text)
        codes = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        word = alpha[codes]
        before = np.empty(len(word), dtype=bool)
        before[0], before[1:] = open_word, word[:-1]
        kept = np.where(word, codes, SPACE)[word | before].astype(np.uint32)
        open_word = bool(word[-1])
        end = [SPACE] if last and open_word else []
        out = np.concatenate([tail, kept, np.array(end, dtype=np.uint32)])
        yield out
        tail = out[-(GRAM - 1) :]


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each symbol, symbols) in blocks of bounded size. A row's parts are never in one block together."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for part in _symbols(text or ""):
            if parts and (size + len(part) > BLOCK or rows[-1] == row or len(parts) >= TEXTS):
                yield np.repeat(rows, [len(p) for p in parts]), np.concatenate(parts)
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(part)
            size += len(part)
    if parts:
        yield np.repeat(rows, [len(p) for p in parts]), np.concatenate(parts)


def text_vectors(texts: list[str | None], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Bundle of every text's n-grams, and whether it has a letter."""
    space = _space(dimensions)
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    lettered = np.zeros(len(texts), dtype=bool)
    for row, symbols in _blocks(texts):
        lettered[np.unique(row[symbols != SPACE])] = True
        n = len(symbols) - GRAM + 1
        if n <= 0:
            continue
        whole = row[:n] == row[GRAM - 1 :]
        codes, local = np.unique(symbols, return_inverse=True)
        wide = len(codes)
        gram = np.zeros(n, dtype=np.int64)
        for j in range(GRAM):
            gram = gram * wide + local[j : j + n]
        gram = gram[whole]
        if not len(gram):
            continue
        owners, owner = np.unique(row[:n][whole], return_inverse=True)
        if wide**GRAM <= 1 << 22:
            present = np.flatnonzero(np.bincount(gram, minlength=wide**GRAM))
            number = np.zeros(wide**GRAM, dtype=np.int64)
            number[present] = np.arange(len(present))
            column = number[gram]
        else:
            present, column = np.unique(gram, return_inverse=True)
        letters = np.stack([codes[present // wide**j % wide] for j in reversed(range(GRAM))], axis=1)
        for at in range(0, len(present), GRAMS):
            inside = (column >= at) & (column < at + GRAMS)
            some = min(GRAMS, len(present) - at)
            counts = np.bincount(owner[inside] * some + column[inside] - at, minlength=len(owners) * some)
            counts = counts.reshape(len(owners), some).astype(np.float32)
            out[owners] += counts @ space.bound(letters[at : at + some])
    return out, lettered


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return vectors / np.where(norm > 0, norm, 1)


def _bundled(dimensions: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                vectors, lettered = text_vectors(part.column(0).to_pylist(), dimensions)
                scaled = np.rint(_unit(vectors) * SCALE).astype(np.int64)
                langs = np.array(part.column(1).to_pylist())
                for lang in set(langs[lettered].tolist()):
                    rows = scaled[lettered & (langs == lang)].sum(axis=0)
                    total[lang] = total.get(lang, 0) + rows
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "bundle": list(total.values())})

    return run


def learn_prototypes(
    docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS
) -> dict[str, np.ndarray]:
    """Unit prototype of each non-null label, from all rows given. Sums are combined before the shuffle; what
    reaches the driver is one vector per label."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    )
    parts = rows.mapInArrow(_bundled(dimensions), "lang string, bundle array<long>")
    sums = parts.select("lang", F.posexplode("bundle").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for label, values in sums.groupBy("lang").agg(F.collect_list(F.struct("i", "v"))).toLocalIterator():
        vector = np.zeros(dimensions)
        for i, v in values:
            vector[i] = v
        found[label] = vector
    if not found:
        return {}
    names = sorted(found)
    return dict(zip(names, _unit(np.stack([found[n] for n in names]))))


def predicted(text: Column, prototypes: dict[str, np.ndarray], spark: SparkSession) -> Column:
    """Struct of lang_pred and score (the cosine cut to 0..1) of a text column.

    Only the text goes to Python; the row's other columns stay where they are. Null texts, texts without a
    letter, and all texts if nothing was learned, are `und` with score 0. Equal cosines go to the label that sorts
    first.
    """
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else np.zeros((0, 1), np.float32)
    shared = spark.sparkContext.broadcast((names, matrix))
    size = len(next(iter(prototypes.values()))) if names else DIMENSIONS

    def run(texts: pa.Array) -> pa.Array:
        names, matrix = shared.value
        lang, score = [], []
        for at in range(0, len(texts), 1024):
            vectors, lettered = text_vectors(texts.slice(at, 1024).to_pylist(), size)
            if not names:
                lettered[:] = False
            cosine = _unit(vectors) @ matrix.T if names else np.zeros((len(vectors), 1))
            best = cosine.argmax(axis=1)
            lang += [names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            score += np.where(lettered, np.clip(cosine.max(axis=1), 0, 1), 0).tolist()
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"]
        )

    return F.arrow_udf(run, "lang_pred string, score double")(text.cast("string"))


def identify(
    docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The columns `keep` (all by default) with lang_pred and score, as `predicted` gives them. Columns named
    lang_pred or score are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    found = fresh(docs, "found")
    rows = docs.select(*keep, predicted(F.col(text), prototypes, docs.sparkSession).alias(found))
    return rows.select(*keep, f"{found}.lang_pred", f"{found}.score")


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


@query("op4_hyperdimensional_language_id")
def op4_hyperdimensional_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    prototypes = learn_prototypes(docs.where(~held_out()).select("text", "lang"))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(rows, prototypes, keep=["doc_id", "held_out"])
