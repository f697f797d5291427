"""Text vectors: a built-in hashed encoder and a hook for external ones."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.session import cut_lineage
from spendlens.sources.deltas import newest, publish_delta, read_deltas, touched

DIMENSIONS = 256
BATCH = 64
KEPT_BYTES = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)  # masks of 0 to 4 bytes


class Encoder(Protocol):
    """Picklable; `encode` is called in tasks, so load heavy models lazily there."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


def hashed_vectors(df: DataFrame, text: str, out: str = "vector", dimensions: int = DIMENSIONS) -> DataFrame:
    """Unit vectors of hashed character 3- to 5-grams of the words, as HashingTF and Normalizer give them."""
    kind = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    names = [*df.columns, out]
    lowered = df.withColumn("_lowered", F.lower(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            matrix = np.stack([hashed_row(t, dimensions) for t in texts]) if texts else np.zeros((0, dimensions))
            offsets = np.arange(0, matrix.size + 1, dimensions, dtype=np.int32)
            vectors = pa.ListArray.from_arrays(offsets, matrix.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=names)

    return lowered.mapInArrow(run, kind)


def hashed_row(text: str, dimensions: int) -> np.ndarray:
    """Unit counts of the gram buckets of a text in lower case; each word is padded with one space."""
    data = np.frombuffer((" " + text + " ").encode(), dtype=np.uint8).copy()
    data[(data >= 9) & (data <= 13)] = 32
    starts = np.nonzero((data & 0xC0) != 0x80)[0]  # bytes at which a character begins
    letter = data[starts] != 32
    ends = np.append(starts, len(data))
    padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.uint32)
    fours = padded[:-3] | padded[1:-2] << 8 | padded[2:-1] << 16 | padded[3:] << 24
    counts = np.zeros(dimensions)
    for n in (3, 4, 5):
        if len(starts) >= n:
            # Only the first and the last character of a gram may be a space.
            inside = np.logical_and.reduce([letter[i : len(letter) - n + 1 + i] for i in range(1, n - 1)])
            first = np.nonzero(inside)[0]
            hashed = murmur(fours, starts[first], ends[first + n] - starts[first])
            counts += np.bincount(hashed % dimensions, minlength=dimensions)
    norm = np.sqrt(counts @ counts)
    return counts / norm if norm > 0 else counts


def murmur(fours: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Murmur3 with seed 42, as HashingTF takes it, of `sizes` bytes from `starts`; `fours` are the four bytes from each place."""
    hashed = np.full(len(starts), 42, dtype=np.uint32)
    for at in range(0, int(sizes.max(initial=0)), 4):
        left = np.clip(sizes - at, 0, 4)
        four = fours[np.minimum(starts + at, len(fours) - 1)] & KEPT_BYTES[left]
        mixed = rotated(four * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        step = rotated(hashed ^ mixed, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        hashed = np.where(left == 4, step, hashed ^ mixed)  # bytes behind a gram are zero, which mix to zero
    hashed ^= sizes.astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        hashed = (hashed ^ (hashed >> np.uint32(shift))) * np.uint32(factor)
    return (hashed ^ (hashed >> np.uint32(16))).view(np.int32)


def rotated(words: np.ndarray, bits: int) -> np.ndarray:
    return (words << np.uint32(bits)) | (words >> np.uint32(32 - bits))


def encoded_vectors(
    df: DataFrame, text: str, encoder: Encoder, out: str = "vector", batch: int = BATCH
) -> DataFrame:
    """Vectors of an external encoder, scaled to unit length, in small batches."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                matrix = np.asarray(encoder.encode(part[text].tolist()), dtype=np.float32)
                norms = np.linalg.norm(matrix, axis=1, keepdims=True)
                matrix = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
                yield part.assign(**{out: list(matrix)})

    return df.mapInPandas(run, schema)


def text_vectors(df: DataFrame, text: str, encoder: Encoder | None = None, out: str = "vector") -> DataFrame:
    if encoder is None:
        return hashed_vectors(df, text, out)
    return encoded_vectors(df, text, encoder, out)


_STORED = "digest string, vector array<float>"


def encoder_version(encoder: Encoder | None) -> str:
    """The name that an encoder's vectors are kept under: its `version`, or else its class."""
    return "hashed" if encoder is None else str(getattr(encoder, "version", type(encoder).__name__))


def stored_vectors(df: DataFrame, text: str, root: str, encoder: Encoder | None = None, out: str = "vector") -> DataFrame:
    """All rows with the vector of their text, each different text encoded once and kept under `root`.

    The key is the text's SHA-256 and the encoder's version. What is kept is looked up in the buckets of the asked
    digests; only texts that are missing are encoded, and of texts stored twice the first vector counts, so an
    encoder that is not repeatable gives one answer. A null text counts as empty.
    """
    spark, folder = df.sparkSession, f"{root}/{encoder_version(encoder)}"
    keyed = df.withColumn("_digest", F.sha2(F.coalesce(text, F.lit("")), 256))
    asked = keyed.groupBy(F.col("_digest").alias("digest")).agg(F.coalesce(F.first(text), F.lit("")).alias("_text"))
    asked = cut_lineage(asked)
    at = newest(spark, folder)
    missing = asked
    if at is not None:
        kept = touched(read_deltas(spark, folder, "vectors", _STORED, at), "digest", asked, at.buckets)
        missing = cut_lineage(asked.join(kept.select("digest"), "digest", "left_anti"))
    if at is None or not missing.isEmpty():
        new = text_vectors(missing, "_text", encoder, "vector").select("digest", F.col("vector").cast("array<float>").alias("vector"))
        publish_delta(spark, folder, {"vectors": (new, "digest")})
        at = newest(spark, folder)
    rows = touched(read_deltas(spark, folder, "vectors", _STORED, at), "digest", asked, at.buckets)
    first = rows.groupBy(F.col("digest").alias("_digest")).agg(F.min_by("vector", "delta").alias(out))
    return keyed.join(first, "_digest").drop("_digest")
