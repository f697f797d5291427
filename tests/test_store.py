"""The knowledge-base store: first write wins, appends write what they add."""

import glob
import os

from pyspark.sql import functions as F

from spendlens.sources.knowledge import ENTRY_FIELDS, compact_store, read_store, read_vectors, upsert_vectors, write_store


def entries(spark, rows):
    """(position, entry_id, name, priority) to entries with one alias of that priority."""
    df = spark.createDataFrame(rows, "position int, entry_id string, canonical_name string, priority int")
    alias = F.struct(F.col("canonical_name").alias("alias"), "priority")
    filled = {f: F.lit(None).cast("string") for f in ENTRY_FIELDS if f not in ("entry_id", "canonical_name")}
    filled |= {"mapping_confidence": F.lit(0.5), "raw_category_labels": F.array().cast("array<string>")}
    filled |= {"document": F.concat(F.lit("d"), F.col("position").cast("string"))}
    return df.select("position", "entry_id", "canonical_name", *[c.alias(n) for n, c in filled.items()], F.array(alias).alias("aliases"))


def held(spark, root):
    rows, aliases = read_store(spark, root)
    return (
        sorted((r.entry_id, r.canonical_name, r.document) for r in rows.collect()),
        sorted((r.alias, r.entry_id, r.priority) for r in aliases.collect()),
    )


def data_files(root):
    return {f: os.path.getsize(f) for f in glob.glob(f"{root}/*/delta=*/bucket=*/*.parquet")}


def test_repeats_inside_a_batch_and_across_batches(spark, tmp_path):
    root = str(tmp_path / "kb")
    write_store(spark, root, entries(spark, [(2, "a", "ONE", 5), (1, "b", "ONE", 7), (3, "c", "TWO", 1), (0, "c", "SIX", 2)]))
    assert held(spark, root)[0] == [("b", "ONE", "d1"), ("c", "SIX", "d0")]
    write_store(spark, root, entries(spark, [(9, "b", "NEW", 1), (8, "z", "SIX", 1), (7, "y", "TWO", 1), (6, "b", "ONE", 9)]))
    rows, aliases = held(spark, root)
    assert rows == [("b", "ONE", "d1"), ("c", "SIX", "d0"), ("y", "TWO", "d7")]
    assert ("ONE", "b", 9) in aliases and ("ONE", "a", 5) in aliases
    before = held(spark, root)
    compact_store(spark, root)
    assert held(spark, root) == before
    write_store(spark, root, entries(spark, [(1, "q", "ONE", 1), (2, "r", "TEN", 1)]))
    assert [r[0] for r in held(spark, root)[0]] == ["b", "c", "r", "y"]
    write_store(spark, root, entries(spark, [(1, "q", "ONE", 1)]), reset=True)
    assert held(spark, root) == ([("q", "ONE", "d1")], [("ONE", "q", 1)])


def test_the_last_batch_of_the_query_holds_all_entries_again(spark, tmp_path, monkeypatch):
    from checks import kb_queries

    spark.createDataFrame([(1, "Supplier#11", 2), (2, "Supplier#22", 3)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(
        str(tmp_path / "supplier.parquet"))
    parts = [(1, "blue cup", 1, "PROMO"), (2, "red cup", 2, "SMALL"), (3, "blue cup", 3, "LARGE"), (4, "tin", 5, "PROMO")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int, p_type string").write.parquet(
        str(tmp_path / "part.parquet"))
    batches = []

    def recorded(spark, root, batch):
        batches.append(sorted((r.entry_id, r.position) for r in batch.select("entry_id", "position").collect()))
        return write_store(spark, root, batch)

    monkeypatch.setattr(kb_queries, "write_store", recorded)
    held = kb_queries.s9_store_batches(spark, str(tmp_path)).collect()
    seeded, placed, again = batches
    assert len(seeded) == 2 and len(placed) == 3
    assert again == sorted(seeded + placed)
    assert sorted(r.canonical_name for r in held) == ["BLUE CUP", "RED CUP", "SUPPLIER HOUSE BB", "SUPPLIER HOUSE CC"]


def test_an_append_rewrites_nothing(spark, tmp_path):
    root = str(tmp_path / "kb")
    write_store(spark, root, entries(spark, [(i, f"e{i}", f"NAME {i}", 1) for i in range(2000)]))
    before = data_files(root)
    write_store(spark, root, entries(spark, [(i, f"e{i}", f"NAME {i}", 1) for i in range(1990, 2010)]))
    after = data_files(root)
    assert all(after[f] == size for f, size in before.items())
    assert read_store(spark, root)[0].count() == 2010
    added = spark.read.parquet(f"{root}/entries/delta=2").count()
    assert added == 10


def test_upsert_takes_the_newest_row_of_an_id(spark, tmp_path):
    root = str(tmp_path / "vectors")
    schema = "id string, document string, embedding array<float>, canonical_name string, mapped_category string, source string"
    rows = lambda *r: spark.createDataFrame([(i, d, [v, 0.0], "n", "", "s") for i, d, v in r], schema)
    upsert_vectors(spark, root, rows(("a", "x", 1.0), ("b", "x", 2.0)))
    upsert_vectors(spark, root, rows(("a", "z", 3.0), ("a", "y", 4.0), ("c", "x", 5.0)))
    got = {r.id: (r.document, r.embedding[0]) for r in read_vectors(spark, root).collect()}
    assert got == {"a": ("y", 4.0), "b": ("x", 2.0), "c": ("x", 5.0)}
    upsert_vectors(spark, root, rows(("d", "x", 6.0)), reset=True)
    assert [r.id for r in read_vectors(spark, root).collect()] == ["d"]
