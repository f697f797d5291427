"""Contiguous shards of near equal bytes from global prefix sums.

Documents are put in order by id (nulls first; equal ids by size and checksum) and range partitioned. Totals of
the partitions give each partition's offset, a window inside the partition the rest. A document goes to the
shard in whose equal share of all bytes its middle lies, so a shard is off its target by half a document at
each end at most. Only ids, sizes and checksums are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.registry import query, table
from spendlens.session import cut_lineage

SHARDS = 16


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus one separator; null has no bytes."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (gapless from 0 in id order), begin (byte offset).

    Rows that are alike in id, size and checksum get slots in any order. An empty table gives no rows.
    """
    words = F.col(text).cast("string")
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        size_of(words).alias("size"),
        F.crc32(F.encode(F.coalesce(words, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = ["doc_id", "size", "text_crc32", "_tie"]
    # Written out: the cut points of a range partitioning are sampled anew by every run of a plan.
    placed = cut_lineage(slim.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    parts = Window.orderBy("_part")  # one row per partition
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    everything = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_from"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rank"),
        F.sum("_bytes").over(everything).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(F.broadcast(offsets), "_part").select(
        "doc_id",
        "size",
        "text_crc32",
        "_all",
        (F.col("_from") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("begin"),
        (F.col("_rank") + F.count("*").over(inside)).alias("_rank"),
    )
    # Doubled so that the middle is whole; decimals, since bytes times shards may pass 2**63.
    middle = (F.col("begin") * 2 + F.col("size")).cast("decimal(38,0)") * shards
    cut = ranked.withColumn("_middle", middle)
    cut = cut.withColumn("shard", F.expr("cast(_middle div (2 * cast(_all as decimal(38,0))) as int)"))
    firsts = cut.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row per shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot"), "begin"
    )


# CRC-32 nibble by nibble, low nibble first, from its generator polynomial.
SQL = """
WITH t AS (
  SELECT list_transform(range(16), lambda n: list_reduce(range(4), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(n AS BIGINT))) AS crc),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(
    regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT)) AS bytes
  FROM documents),
c AS (
  SELECT doc_id, size, xor(list_reduce(bytes, lambda a, b:
    xor(
      xor(a >> 4, crc[((xor(a, b) & 15) + 1)::INT]) >> 4,
      crc[((xor(xor(a >> 4, crc[((xor(a, b) & 15) + 1)::INT]), b >> 4) & 15) + 1)::INT]),
    CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM d, t),
p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS total,
    row_number() OVER (ORDER BY doc_id) AS n
  FROM c),
s AS (SELECT *, CAST((2 * upto - size) * 16 // (2 * total) AS INT) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY n) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM s
"""


@query("op5_prefix_sum_shards", SQL)
def op5_prefix_sum_shards(spark, sf):
    shards = assign_shards(table(spark, sf, "documents"))
    return shards.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
