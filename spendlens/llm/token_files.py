"""Token counts of flat token files by a separator scan.

A flat file holds ids as little-endian unsigned numbers and nothing else; a separator id ends each document.
Blocks of fixed size are searched for it with one vectorised comparison each. A prefix scan over the blocks of a
file gives each block its first document's number and start, which may lie many blocks back.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.llm.files import at_random, attempt_name, create, new_folder
from spendlens.llm.registry import query, table
from spendlens.llm.tokens import token_blocks
from spendlens.session import cut_lineage

BLOCK_IDS = 1 << 20
TASK_BLOCKS = 4  # blocks a scan task reads on average
RUN = 1024  # blocks of one file whose summaries one scan task takes

_WRITTEN = "doc_id long, file string, number long, file_ids long"


def _writer(path: str, separator: int, folder: str, kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        name, out, number, total = attempt_name(folder, "bin"), None, 0, 0
        for batch in batches:
            for first, last, ids, counts in token_blocks(batch.column(1), path, plain=True):
                out = out or create(name)
                if (ids == separator).any():
                    raise ValueError("a text holds the separator id")
                ends = np.cumsum(counts)
                flat = np.insert(ids, ends, separator)
                if len(flat) and int(flat.max()) > np.iinfo(kind).max:
                    raise ValueError(f"ids do not fit {kind}")
                out.write(flat.astype(f"<{np.dtype(kind).str[1:]}").tobytes())
                n, total = last - first, total + len(flat)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array([name] * n, pa.string()),
                        pa.array(np.arange(number, number + n)),
                        pa.array([total] * n, pa.int64()),
                    ],
                    names=["doc_id", "file", "number", "file_ids"],
                )
                number += n
        if out:
            out.close()

    return run


def write_token_files(
    docs: DataFrame, path: str, separator: int, kind: str = "uint16", id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write one flat file per partition and return the order of documents: doc_id, file, number, file_ids.

    `file_ids` is the length of the file up to this document's block; its maximum is the file's length. Null
    texts are empty documents. Strings of special tokens count as ordinary text, so a special token's id never
    occurs inside a document; any other separator that does is refused.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    folder = new_folder(docs.sparkSession, "tokens")
    return cut_lineage(rows.mapInArrow(_writer(path, separator, folder, kind), _WRITTEN))


def _scan(separator: int, kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        width = np.dtype(kind).itemsize
        for batch in batches:
            for file, block, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                with at_random(file) as source:
                    data = source.read_at(n * width, first * width)
                if len(data) != n * width:
                    raise ValueError(f"{file} is shorter than listed")
                ends = np.flatnonzero(np.frombuffer(data, dtype=f"<{np.dtype(kind).str[1:]}") == separator) + first
                yield pa.RecordBatch.from_pydict(
                    {"file": [file], "block": [block], "stop": [first + n], "ends": [ends.astype(np.int64)]},
                    pa.schema(
                        [
                            ("file", pa.string()),
                            ("block", pa.int64()),
                            ("stop", pa.int64()),
                            ("ends", pa.list_(pa.int64())),
                        ]
                    ),
                )

    return run


def count_tokens(
    spark: SparkSession, files: DataFrame, separator: int, kind: str = "uint16", block_ids: int = BLOCK_IDS
) -> DataFrame:
    """Documents of flat files (file, ids): file, number, start, n_tokens, closed.

    `start` is the first id's place in the file, `n_tokens` leaves the separator out. Ids after the last
    separator are a document that is not closed; a file without ids has no documents.
    """
    blocks = files.where("ids > 0").select(
        "file", "ids", F.explode(F.expr(f"sequence(0L, (ids - 1) div {block_ids})")).alias("block")
    )
    blocks = blocks.select(
        "file",
        "block",
        (F.col("block") * block_ids).alias("first"),
        F.least(F.lit(block_ids).cast("long"), F.col("ids") - F.col("block") * block_ids).alias("n"),
    )
    # A stated number of partitions: by size alone adaptive execution would give all blocks to one task.
    n = blocks.count()
    spread = blocks.repartition(n // TASK_BLOCKS + 1, "file", "block")
    found = cut_lineage(spread.mapInArrow(_scan(separator, kind), "file string, block long, stop long, ends array<long>"))
    summary = found.select(
        "file",
        "block",
        F.expr(f"block div {RUN}").alias("run"),
        F.size("ends").cast("long").alias("n"),
        F.try_element_at("ends", F.lit(-1)).alias("last"),
    )
    # Prefix scan in two steps: over runs of blocks, then over the blocks of each run.
    runs = summary.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    before = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "file", "run", F.sum("n").over(before).alias("run_n"), F.max("last").over(before).alias("run_last")
    )
    inner = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        "file", "run", "block", F.sum("n").over(inner).alias("own_n"), F.max("last").over(inner).alias("own_last")
    )
    zero = F.lit(0).cast("long")
    carried = carried.join(runs, ["file", "run"]).select(
        "file",
        "block",
        (F.coalesce("own_n", zero) + F.coalesce("run_n", zero)).alias("number"),
        (F.coalesce(F.greatest("own_last", "run_last"), F.lit(-1).cast("long")) + 1).alias("start"),
    )
    tails = files.where("ids > 0").select("file", F.expr(f"(ids - 1) div {block_ids}").alias("last_block"))
    joined = found.join(carried, ["file", "block"]).join(tails, "file")
    # Each document's start is the separator before it; ids after a file's last separator make an open document.
    open_end = (F.col("block") == F.col("last_block")) & (
        F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.col("start")) < F.col("stop")
    )
    stops = F.when(open_end, F.concat("ends", F.array("stop"))).otherwise(F.col("ends"))
    rows = joined.select("file", "number", "start", "ends", F.posexplode(stops).alias("i", "at"))
    begin = F.when(F.col("i") == 0, F.col("start")).otherwise(F.expr("ends[i - 1] + 1"))
    return rows.select(
        "file",
        (F.col("number") + F.col("i")).alias("number"),
        begin.alias("start"),
        (F.col("at") - begin).alias("n_tokens"),
        (F.col("i") < F.size("ends")).alias("closed"),
    )


@query("op6_separator_scan")
def op6_separator_scan(spark, sf):
    import public_tokenizers

    separator = 50256  # <|endoftext|>
    docs = table(spark, sf, "documents")
    order = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), separator)
    files = order.groupBy("file").agg(F.max("file_ids").alias("ids"))
    counts = count_tokens(spark, files, separator)
    return order.join(counts, ["file", "number"]).select("doc_id", "n_tokens", "start", "number")
