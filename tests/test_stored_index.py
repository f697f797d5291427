"""Stored inverted indexes: same answers as an index made for one search, pruned scans, segments."""

import random

import pytest
from pyspark.sql import functions as F

from spendlens.functions.terms import words_and_pairs
from spendlens.operators import lexical, stored_index
from spendlens.operators.lexical import bm25_index, bm25_query_terms, sparse_top_k, tfidf_index, tfidf_query_terms
from spendlens.operators.stored_index import append_index, build_index, merge_segments, open_index, search_terms, search_texts
from spendlens.plans.search import Knowledge, search

WORDS = [f"w{i}" for i in range(60)]


def texts(rng, ids, longest=40):
    return [(i, " ".join(rng.choice(WORDS[: rng.choice([3, 20, 60])]) for _ in range(rng.randrange(longest)))) for i in ids]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def plain(found):
    return sorted(tuple(r) for r in found.select("query_id", "doc_id", "score", "rank").collect())


def asked(spark, rng, n=12):
    rows = [(f"q{i}", " ".join(rng.choice(WORDS + ["none"]) for _ in range(1 + i % 5))) for i in range(n)]
    return spark.createDataFrame([*rows, ("q", ""), ("common", "w0 w1 w2 w1")], "query_id string, text string")


def query_terms(queries):
    return bm25_query_terms(queries, "query_id", F.split("text", " "))


@pytest.mark.parametrize("literal", [512, 0])
def test_segments_answer_like_one_index(spark, tmp_path, monkeypatch, literal):
    monkeypatch.setattr(lexical, "BUCKET_ROWS", 20)
    monkeypatch.setattr(stored_index, "BUCKET_ROWS", 20)
    monkeypatch.setattr(stored_index, "LITERAL_TERMS", literal)
    rng = random.Random(5)
    first = texts(rng, range(90), 15) + [(900, None), (901, "")]
    more = texts(rng, range(90, 150), 80)
    queries = asked(spark, rng)
    root = str(tmp_path / "index")
    index = build_index(table(spark, first), "doc_id", "text", root, bins=4)
    assert plain(search_terms(index, query_terms(queries), 5)) == plain(
        sparse_top_k(query_terms(queries), bm25_index(table(spark, first), "doc_id", "text"), 5)
    )
    append_index(index, table(spark, first[:40] + more), "text")  # known ids are left out
    append_index(open_index(spark, root), table(spark, first), "text")  # a batch without new ids
    grown = open_index(spark, root)
    assert (grown.version, len(grown.segments), grown.documents) == (3, 3, 152)
    want = plain(sparse_top_k(query_terms(queries), bm25_index(table(spark, first + more), "doc_id", "text"), 5))
    assert plain(search_terms(grown, query_terms(queries), 5)) == want
    whole = merge_segments(grown)
    assert len(whole.segments) == 1 and plain(search_terms(open_index(spark, root), query_terms(queries), 5)) == want
    # An older version is read as it was.
    assert plain(search_terms(index, query_terms(queries), 100)) == plain(
        sparse_top_k(query_terms(queries), bm25_index(table(spark, first), "doc_id", "text"), 100)
    )


def test_tfidf_segments(spark, tmp_path):
    rng = random.Random(6)
    first, more = texts(rng, range(50)), texts(rng, range(50, 90))
    queries = asked(spark, rng)
    root = str(tmp_path / "index")
    grown = append_index(build_index(table(spark, first), "doc_id", "text", root, "tfidf"), table(spark, more), "text")
    postings, terms = tfidf_index(table(spark, first + more), "doc_id", "text")
    want = plain(sparse_top_k(tfidf_query_terms(queries, terms, "query_id", "text"), postings, 5))
    assert plain(search_texts(grown, queries, 5, "query_id", "text")) == want


def test_scan_reads_the_bins_and_terms_of_the_queries(spark, tmp_path, capsys):
    root = str(tmp_path / "index")
    index = build_index(table(spark, texts(random.Random(7), range(80))), "doc_id", "text", root, bins=16)
    terms = spark.createDataFrame([("q", "w3", 1.0), ("q", "w5", 1.0)], "query_id string, term string, qweight double")
    bins = {r[0] for r in terms.select(stored_index.term_bin(F.col("term"), 16)).collect()}
    rows = stored_index._pruned(index, terms)("postings")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and all(str(b) in plan for b in bins)
    assert "PushedFilters" in plan and "In(term, [w3,w5])" in plan.replace("(term, [w5,w3])", "(term, [w3,w5])")
    folders = {f.split("/bin=")[1].split("/")[0] for f in rows.inputFiles()}
    assert folders <= {str(i) for i in range(16)}
    assert {r.bin for r in rows.select("bin").distinct().collect()} == bins


def test_heavy_postings_are_those_of_common_terms(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"w0 {rng.choice(['w1', 'w2'])} {rng.choice(WORDS)} w0" + " w3" * (i % 5 == 0)) for i in range(200)]
    index = build_index(table(spark, rows[:150]), "doc_id", "text", str(tmp_path / "index"), bins=4)
    index = append_index(index, table(spark, rows[150:]), "text")
    sizes = stored_index._stored(index, "sizes").groupBy("segment", "term").agg(F.sum("n").alias("n"))
    common = {(r.segment, r.term) for r in sizes.where(F.col("n") > stored_index.HEAVY).collect()}
    heavy = stored_index._stored(index, "heavy").groupBy("segment", "term").count().collect()
    assert {(r.segment, r.term) for r in heavy} == common and {r["count"] for r in heavy} == {stored_index.HEAVY}
    assert 0 < len(common) < sizes.count()
    queries = asked(spark, rng)
    for k in (5, 100):
        want = plain(sparse_top_k(query_terms(queries), bm25_index(table(spark, rows), "doc_id", "text"), k))
        assert plain(search_terms(index, query_terms(queries), k)) == want


def test_a_text_is_cut_once_for_words_and_pairs(spark):
    rows = table(spark, [(1, "Ab c9 d ef"), (2, None), (3, "xx")]).repartition(2)
    cut = rows.select("doc_id", words_and_pairs(F.col("text")).alias("terms"))
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = {r.doc_id: r.terms for r in cut.collect()}
    assert got == {1: ["ab", "c9", "ef", "ab c9", "c9 ef"], 2: None, 3: ["xx"]}


def test_empty_index(spark, tmp_path):
    root = str(tmp_path / "index")
    assert open_index(spark, root) is None
    index = build_index(table(spark, []), "doc_id", "text", root)
    queries = asked(spark, random.Random(8))
    assert search_terms(index, query_terms(queries), 5).count() == 0
    grown = append_index(index, table(spark, [(1, "w1 w2"), (2, "w1")]), "text")
    assert {r.doc_id for r in search_terms(grown, query_terms(queries), 5).collect()} <= {1, 2}
    with pytest.raises(ValueError):
        search_texts(index, queries, 5, "query_id", "text")


@pytest.mark.parametrize("kind", ["bm25", "tfidf"])
def test_search_on_a_stored_index(spark, tmp_path, kind):
    from spendlens.operators.kb_build import alias_table
    from spendlens.plans.search import index_knowledge
    from spendlens.sources.knowledge import read_kb_json
    from tests.test_search import RECORDS
    import json

    path = tmp_path / "kb.json"
    path.write_text(json.dumps(RECORDS))
    entries = read_kb_json(spark, str(path))
    aliases = alias_table(entries)
    asked_texts = spark.createDataFrame([("COSTCO GAS",), ("GOODLIFE CLUBS",), ("PUBLIC UNIVERSITY FEES",), ("ZZ QQ",)], "text string")
    index = build_index(entries, "entry_id", "document", str(tmp_path / "index"), kind)
    got = search(asked_texts, Knowledge(entries, aliases, index), scorer="overlap").drop("decomposed")
    want = search(asked_texts, index_knowledge(entries, aliases, kind), scorer="overlap").drop("decomposed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_terms_are_counted_inside_the_row_of_a_document(spark):
    from spendlens.operators.lexical import document_terms

    rows = table(spark, [(1, "b a b"), (2, ""), (3, None), (4, "c"), (4, "c d"), (None, "e"), (None, "e a"), (5, "a")])
    found = document_terms(rows, "doc_id", F.split(F.nullif("text", F.lit("")), " "))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [
        (1, "a", 1), (1, "b", 2), (4, "c", 2), (4, "d", 1), (5, "a", 1), (None, "a", 1), (None, "e", 2)]))
    alone = document_terms(rows.where("doc_id <> 4"), "doc_id", F.split("text", " "))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 50_000])
def test_few_and_many_query_terms_answer_alike(spark, monkeypatch, few):
    monkeypatch.setattr(lexical, "BUCKET_ROWS", 20)
    monkeypatch.setattr(lexical, "FEW_TERMS", few)
    rng = random.Random(9)
    rows = texts(rng, range(120))
    queries = asked(spark, rng)
    postings = bm25_index(table(spark, rows), "doc_id", "text")
    want = {}
    for r in postings.join(query_terms(queries), "term").collect():
        want[r.query_id, r.doc_id] = want.get((r.query_id, r.doc_id), 0.0) + r.qweight * r.weight
    best = []
    for query in {q for q, _ in want}:
        ranked = sorted((-round(s, 12), d) for (q, d), s in want.items() if q == query and s > 0)[:4]
        best += [(query, d, round(-s, 6), i) for i, (s, d) in enumerate(ranked, 1)]
    assert plain(sparse_top_k(query_terms(queries), postings, 4)) == sorted(best)


@pytest.mark.parametrize("kind", ["tfidf", "bm25"])
def test_a_segment_is_written_without_a_copy_of_its_postings(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(stored_index, "PIECE_ROWS", 30)
    written, cut = [], stored_index.cut_lineage
    monkeypatch.setattr(stored_index, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    index = build_index(table(spark, texts(random.Random(3), range(60))), "doc_id", "text", str(tmp_path / "index"), kind, bins=3)
    append_index(index, table(spark, texts(random.Random(4), range(40, 90))), "text")
    assert not [columns for columns in written if "tf" in columns]
    rows = stored_index._stored(open_index(spark, str(tmp_path / "index")), "postings")
    assert len(rows.inputFiles()) > 12  # a bin is written by several tasks
    assert rows.select("doc_id", "term").distinct().count() == rows.count() > 0
