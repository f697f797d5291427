"""Searches against brute force, and the cascade on small knowledge bases."""

import json
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from spendlens.operators import lexical
from spendlens.operators.dense import nearest
from spendlens.operators.kb_build import alias_table
from spendlens.operators.ranking import hashed_rank
from spendlens.plans.classify import Stage, classify
from spendlens.plans.search import index_knowledge, search
from spendlens.sources.knowledge import read_kb_json, read_store, write_store


def test_sparse_top_k_with_hot_term(spark, monkeypatch):
    """A term in every document, salted buckets, and repeated scores."""
    monkeypatch.setattr(lexical, "BUCKET_ROWS", 7)
    rng = np.random.default_rng(3)
    postings = [(d, "hot", float(rng.integers(1, 9)) / 16) for d in range(60)]
    postings += [(int(d), f"t{t}", float(rng.integers(1, 40)) / 8) for t in range(12) for d in rng.choice(60, 9, replace=False)]
    asked = [(q, t, float(rng.integers(1, 5))) for q in range(8) for t in {"hot", *(f"t{i}" for i in rng.integers(0, 12, 3))}]
    found = lexical.sparse_top_k(
        spark.createDataFrame(asked, "query_id int, term string, qweight double"),
        spark.createDataFrame(postings, "doc_id int, term string, weight double"),
        4,
    ).collect()
    scores = defaultdict(float)
    for q, term, qw in asked:
        for d, t, w in postings:
            if t == term:
                scores[q, d] += qw * w
    for q in range(8):
        best = sorted((-round(s, 6), d) for (x, d), s in scores.items() if x == q)[:4]
        assert sorted((-r["score"], r["doc_id"]) for r in found if r["query_id"] == q) == best


def test_nearest_matches_brute_force(spark):
    """Clusters, identical vectors, negatives and a zero vector, in small blocks."""
    rng = np.random.default_rng(5)
    base = np.repeat(rng.normal(size=(5, 6)), 24, axis=0) + rng.normal(scale=0.1, size=(120, 6))
    base[40:80] = base[40]
    base[100] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "i int, v array<double>")
    found = nearest(
        df.select(F.col("i").alias("query_id"), F.col("v").alias("vector")),
        df.select(F.col("i").alias("entry_id"), F.col("v").alias("vector")),
        5, pivots=7, block=16,
    ).collect()
    norms = np.linalg.norm(base, axis=1, keepdims=True)
    unit = np.divide(base, norms, out=np.zeros_like(base), where=norms > 0)
    sims = np.round(np.clip(unit @ unit.T, 0, 1), 6)
    got = defaultdict(list)
    for r in found:
        got[r["query_id"]].append((r["rank"], r["entry_id"]))
    for i in range(120):
        best = sorted(range(120), key=lambda j: (-sims[i, j], j))[:5]
        assert [j for _, j in sorted(got[i])] == best, i


def test_hashed_rank_is_a_row_number(spark):
    df = spark.range(500).select("id", (F.col("id") % 3 == 0).alias("k"), F.md5(F.col("id").cast("string")).alias("d"))
    rows = hashed_rank(df, ["k"], "d", "rank", "size", digits=1).collect()
    for key in (True, False):
        mine = sorted((r["d"], r["rank"]) for r in rows if r["k"] == key)
        assert [rank for _, rank in mine] == list(range(1, len(mine) + 1))
        assert {r["size"] for r in rows if r["k"] == key} == {len(mine)}


RECORDS = [
    {"canonical_name": "COSTCO", "aliases": ["COSTCO", "COSTCO WHOLESALE"], "mapped_category": "Shopping & Retail",
     "mapping_confidence": 0.92, "metadata_text": "warehouse retailer", "source": "curated_public"},
    {"canonical_name": "AMAZON", "aliases": ["AMAZON"], "mapped_category": "Shopping & Retail",
     "mapping_confidence": 0.95, "metadata_text": "online retailer", "source": "curated_public"},
    {"canonical_name": "UNIVERSITY OF OTTAWA", "aliases": ["HTSP- UNIV OTTAWA"], "mapped_category": None,
     "mapping_confidence": 0.0, "metadata_text": "public university with tuition fees"},
    {"canonical_name": "GOODLIFE FITNESS", "display_name": "GoodLife Fitness", "aliases": ["GOODLIFE FITNESS"],
     "mapped_category": "Entertainment & Recreation", "mapping_confidence": 0.91, "metadata_text": "gym and fitness club"},
    {"canonical_name": "", "aliases": []},
]


def knowledge(spark, tmp_path, lexical_kind="tfidf"):
    path = tmp_path / "kb.json"
    path.write_text(json.dumps(RECORDS))
    entries = read_kb_json(spark, str(path))
    return index_knowledge(entries, alias_table(entries), lexical_kind)


def test_search_exact_brand_and_overlap(spark, tmp_path):
    kb = knowledge(spark, tmp_path, "bm25")
    assert kb.entries.count() == 4
    texts = spark.createDataFrame([("COSTCO",), ("COSTCO GAS W1263",), ("GOODLIFE CLUBS",), ("ZZZZ QQQQ",), ("AB",)], "text string")
    rows = {r["text"]: r for r in search(texts, kb).collect()}
    assert (rows["COSTCO"]["strategy"], rows["COSTCO"]["similarity"]) == ("exact", 1.0)
    assert (rows["COSTCO GAS W1263"]["strategy"], rows["COSTCO GAS W1263"]["matched_alias"]) == ("exact", "COSTCO")
    assert rows["COSTCO GAS W1263"]["decomposed"]["descriptor_context"] == "gas station, fuel"
    assert (rows["GOODLIFE CLUBS"]["strategy"], rows["GOODLIFE CLUBS"]["entry_id"]) == ("dense_lexical", "merchant:3")
    assert rows["ZZZZ QQQQ"]["entry_id"] is None and rows["AB"]["entry_id"] is None


class Fixed:
    """A model that answers the same for every text and keeps the text."""

    def __init__(self, category, confidence):
        self.category, self.confidence = category, confidence

    def score(self, df, text):
        kept = [c for c in df.columns if c not in ("category", "confidence")]
        return df.select(*kept, F.lit(self.category).alias("category"), F.lit(self.confidence).alias("confidence"))


def test_cascade_sources(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "PARKING LOT DOWNTOWN"), (2, "AMAZON DOWNLOADS"), (3, "HTSP- UNIV OTTAWA"), (4, "TOTALLY DIFFERENT"),
         (5, "POS PURCHASE - 1234 COSTCO OTTAWA ON"), (6, "Payroll Deposit X"), (7, ""), (8, "TOTALLY DIFFERENT")],
        "i int, description string",
    )
    out = classify(rows, kb=knowledge(spark, tmp_path, None), stages=[None, Stage("finetune", Fixed("Income", 0.87))])
    got = {r["i"]: (r["source"], r["category"], r["flagged_for_review"]) for r in out.collect()}
    assert got == {
        1: ("rules", "Transportation", False),
        2: ("knowledge_base", "Entertainment & Recreation", False),
        3: ("finetune_metadata", "Income", False),
        4: ("finetune", "Income", False),
        5: ("knowledge_base", "Shopping & Retail", False),
        6: ("direction", "Income", False),
        7: ("finetune", "Income", True),
        8: ("finetune", "Income", False),
    }


def test_store_append_and_reset(spark, tmp_path):
    kb = knowledge(spark, tmp_path, None)
    root = str(tmp_path / "store")
    assert write_store(spark, root, kb.entries.where("canonical_name = 'COSTCO'")) == 1
    assert write_store(spark, root, kb.entries) == 2
    entries, aliases = read_store(spark, root)
    assert (entries.count(), aliases.where("alias = 'COSTCO WHOLESALE'").count()) == (4, 1)
    write_store(spark, root, kb.entries.where("canonical_name = 'AMAZON'"), reset=True)
    assert read_store(spark, root)[0].count() == 1
