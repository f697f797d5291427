"""An inverted index on disk, written once and searched often.

A segment holds the postings of one batch of documents: term, document, count and document length, in folders by a
hash of the term (bins) and sorted by term in them, with the size and best share of each (term, level), the heaviest
postings of each term that has more than HEAVY and the documents' ids. Weights depend on the whole corpus, so they are not stored: a search
works them out for the postings it reads, from the segments' totals. Appending writes a new segment and touches no
other. A manifest lists the segments of each version; a batch that was lost half way is never seen.

A search reads the folders of its terms' bins, in them the row groups that hold its terms, and no document.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.rows import exploded
from spendlens.functions.terms import index_words, words_and_pairs, words_and_pairs_size
from spendlens.operators.lexical import (
    BUCKET_ROWS,
    Postings,
    bm25_idf,
    bm25_share,
    document_norms,
    document_terms,
    sparse_top_k,
    tfidf_query_terms,
    tfidf_weight,
    weight_bucket,
)
from spendlens.operators.ranking import top_n
from spendlens.session import cut_lineage

HEAVY = 64  # postings of a term kept for the floor of a search's scores; terms with no more need no copy of theirs
BIN_ROWS = 2_000_000  # postings a bin should hold
MOST_BINS = 4096
PIECE_ROWS = 1_000_000  # postings that a task of a write should hold
SPLIT = 4  # pieces over which a level of one term is dealt
LITERAL_TERMS = 512  # up to so many different terms are filters of the scan; more are a join
MANIFEST = (
    "version long, segment long, documents long, texts long, tokens long, kind string, bins int, doc string,"
    " doc_type string"
)


class StoredIndex(NamedTuple):
    """One version of an index: its folder, kind ("bm25" or "tfidf"), document column and segments."""

    spark: SparkSession
    root: str
    version: int
    kind: str
    bins: int
    doc: str
    doc_type: str
    segments: tuple[tuple[int, int, int, int], ...]  # segment, documents, of them with a text, tokens

    @property
    def documents(self) -> int:
        return sum(s[1] for s in self.segments)

    @property
    def average(self) -> float:
        """Terms of a text; null texts have no length."""
        return _average(sum(s[2] for s in self.segments), sum(s[3] for s in self.segments))


def _average(texts: int, tokens: int) -> float:
    return tokens / texts if tokens else 1.0


def open_index(spark: SparkSession, root: str) -> StoredIndex | None:
    """The newest version, or None. The manifest has one row per segment and version."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
        newest = rows.where(F.col("version") == rows.agg(F.max("version")).scalar()).orderBy("segment").collect()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    head = newest[0]
    segments = tuple((r.segment, r.documents, r.texts, r.tokens) for r in newest)
    return StoredIndex(spark, root, head.version, head.kind, head.bins, head.doc, head.doc_type, segments)


def _publish(index: StoredIndex) -> StoredIndex:
    rows = [
        (index.version, *segment, index.kind, index.bins, index.doc, index.doc_type) for segment in index.segments
    ]
    # One small file, so a version is listed whole or not at all.
    index.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{index.root}/manifest")
    return index


def term_bin(term: Column, bins: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(bins)).cast("int")


def _schema(index: StoredIndex, name: str) -> str:
    """Columns of a table's files; a segment without rows has no file to tell them."""
    postings = f"`{index.doc}` {index.doc_type}, length int, term string, tf long, share double, bucket int"
    return {
        "postings": f"{postings}, segment long, bin int",
        "heavy": f"{postings}, segment long, bin int",
        "sizes": "term string, bucket int, n long, top_share double, segment long, bin int",
        "documents": f"`{index.doc}` {index.doc_type}, length int, segment long",
    }[name]


def _stored(index: StoredIndex, name: str) -> DataFrame:
    """A table of all segments; `bin` and `segment` are folders."""
    folders = [f"{index.root}/{name}/segment={s[0]}" for s in index.segments]
    reader = index.spark.read.option("basePath", f"{index.root}/{name}").schema(_schema(index, name))
    return reader.parquet(*folders)


def _counted(docs: DataFrame, doc: str, text: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(doc, length) and (doc, length, term, tf)."""
    terms, length = index_words(F.col(text)), F.size(index_words(F.col(text)))
    if kind == "tfidf":
        terms, length = words_and_pairs(F.col(text)), words_and_pairs_size(F.col(text))
    cut = docs.select(doc, terms.alias("tokens"))
    sized = cut.select(doc, F.size("tokens").alias("length"), "tokens")
    return docs.select(doc, length.alias("length")), document_terms(sized, doc, F.col("tokens"), "length")


def _write_segment(index: StoredIndex, segment: int, counts: DataFrame, lengths: DataFrame) -> StoredIndex:
    """Postings, sizes, heaviest postings and ids of one batch.

    A bin is dealt in pieces of about PIECE_ROWS, by term and level and, for the common terms, by id. The number of terms
    is known by then, so the texts are not cut once more to find ranges. What follows from the other columns is worked
    out behind the shuffle.
    """
    root, doc = index.root, index.doc
    lengths.write.mode("overwrite").parquet(f"{root}/documents/segment={segment}")
    own = index._replace(segments=((segment, 0, 0, 0),))
    documents, texts, tokens = _stored(own, "documents").agg(F.count("*"), F.count("length"), F.coalesce(F.sum("length"), F.lit(0))).first()
    share = bm25_share(F.col("tf"), F.col("length"), F.lit(_average(texts, tokens)))
    rows = counts.withColumn("bucket", weight_bucket(share)).withColumn("bin", term_bin(F.col("term"), index.bins))
    pieces = tokens // (index.bins * PIECE_ROWS) + 1
    order = ["bin", "term", "bucket", doc]

    def write(df: DataFrame, name: str) -> None:
        writer = df.write.mode("overwrite").partitionBy("bin")
        writer.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{root}/{name}/segment={segment}")

    level, part = F.pmod(F.xxhash64("term", "bucket"), F.lit(pieces)), F.pmod(F.xxhash64(doc), F.lit(SPLIT))
    task = F.col("bin") * F.lit(pieces) + F.pmod(level + part, F.lit(pieces))
    dealt = rows.repartitionById(index.bins * pieces, task.cast("int")).sortWithinPartitions(*order)
    columns = [doc, "length", "term", "tf", "share", "bucket", "bin"]
    write(dealt.withColumn("share", share).select(*columns), "postings")
    rows = _stored(own, "postings").drop("segment")
    sizes = rows.groupBy("bin", "term", "bucket").agg(F.count("*").alias("n"), F.max("share").alias("top_share"))
    write(sizes.repartitionByRange("bin", "term").sortWithinPartitions("bin", "term"), "sizes")
    common = cut_lineage(_common(_stored(own, "sizes"), ["bin", "term"]))
    common_rows = rows.join(common, ["bin", "term"], "left_semi")
    heavy = top_n(common_rows, ["bin", "term"], [F.desc("share"), F.asc(doc)], HEAVY).drop("rank")
    write(heavy.repartitionByRange("bin", "term").sortWithinPartitions("bin", "term"), "heavy")
    return index._replace(segments=(*index.segments, (segment, documents, texts, tokens)))


def _common(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Terms with more than HEAVY postings."""
    return sizes.groupBy(*keys).agg(F.sum("n").alias("_n")).where(F.col("_n") > HEAVY).select(*keys)


def build_index(
    docs: DataFrame, doc: str, text: str, root: str, kind: str = "bm25", bins: int | None = None
) -> StoredIndex:
    """Writes the first segment of a new version, which replaces what the folder listed before.

    Null texts are documents without terms or a length. A document id should occur once; ids are compared on append. `bins`
    follows from the number of postings if it is not given.
    """
    spark = docs.sparkSession
    if kind not in ("bm25", "tfidf"):
        raise ValueError(f"no such kind of index: {kind}")
    before = open_index(spark, root)
    version = before.version + 1 if before else 1
    lengths, counts = _counted(docs, doc, text, kind)
    if bins is None:
        counts = cut_lineage(counts)
        bins = max(8, min(MOST_BINS, counts.count() // BIN_ROWS + 1))
    index = StoredIndex(spark, root, version, kind, bins, doc, docs.schema[doc].dataType.simpleString(), ())
    return _finish(_write_segment(index, _new_number(before), counts, lengths))


def _new_number(before: StoredIndex | None) -> int:
    return max((s[0] for s in before.segments), default=0) + 1 if before else 1


def append_index(index: StoredIndex, docs: DataFrame, text: str) -> StoredIndex:
    """A version with one more segment, of the documents whose ids the index lacks."""
    doc = index.doc
    fresh = docs.join(_stored(index, "documents").select(doc), doc, "left_anti")
    lengths, counts = _counted(fresh, doc, text, index.kind)
    grown = index._replace(version=index.version + 1)
    return _finish(_write_segment(grown, _new_number(index), counts, lengths))


def merge_segments(index: StoredIndex) -> StoredIndex:
    """A version of one segment with the postings of all; reads the index only."""
    rows = _stored(index, "postings").select(index.doc, "length", "term", "tf")
    lengths = _stored(index, "documents").select(index.doc, "length")
    merged = index._replace(version=index.version + 1, segments=())
    return _finish(_write_segment(merged, _new_number(index), rows, lengths))


def _finish(index: StoredIndex) -> StoredIndex:
    """TF-IDF needs each document's norm, which every batch changes: one row per document and version."""
    if index.kind == "tfidf":
        rows = _stored(index, "postings").select(index.doc, "term", "tf")
        norms = document_norms(rows, index.doc, F.lit(index.documents))
        norms.write.mode("overwrite").parquet(f"{index.root}/norms/version={index.version}")
    return _publish(index)


def _tfidf_terms(index: StoredIndex, sizes: DataFrame) -> DataFrame:
    hits = sizes.groupBy("term").agg(F.sum("n").alias("hits"))
    return hits.select("term", tfidf_weight(F.lit(index.documents), F.col("hits")).alias("idf"))


def _pruned(index: StoredIndex, terms: DataFrame):
    """A reader of the index's tables that skips what the terms cannot need.

    Bins, at most MOST_BINS numbers, are partition filters. Terms are filters of the scan if they are few; else
    the rows of their bins are joined with them.
    """
    terms = cut_lineage(terms.select("term").distinct())
    bins = sorted(r[0] for r in terms.select(term_bin(F.col("term"), index.bins)).distinct().collect())
    few = [r[0] for r in terms.limit(LITERAL_TERMS + 1).collect()]

    def read(name: str) -> DataFrame:
        rows = _stored(index, name).where(F.col("bin").isin(bins))
        if len(few) <= LITERAL_TERMS:
            return rows.where(F.col("term").isin(few))
        return rows.join(terms, "term", "left_semi")

    return read


def _bm25_postings(index: StoredIndex, terms: DataFrame) -> Postings:
    """Postings of the terms with today's weights.

    Levels were cut by the share at their segment's average length. A longer average lifts a share by the ratio of
    the averages at most, which bounds what a level can hold.
    """
    read, doc = _pruned(index, terms), index.doc
    average = F.lit(index.average)
    sizes = cut_lineage(read("sizes"))
    hits = sizes.groupBy("term").agg(F.sum("n").alias("hits"))
    idf = cut_lineage(hits.select("term", bm25_idf(F.lit(index.documents), F.col("hits")).alias("idf")))
    lift = F.lit(1.0)
    for segment, _, texts, tokens in index.segments:
        longer = max(1.0, index.average / _average(texts, tokens)) * (1 + 1e-9)
        lift = F.when(F.col("segment") == segment, longer).otherwise(lift)
    levels = (
        sizes.join(idf, "term")
        .groupBy("term", "bucket")
        .agg(
            F.max(F.col("idf") * F.col("top_share") * lift).alias("top"),
            F.ceil(F.sum("n") / F.lit(BUCKET_ROWS)).cast("int").alias("salts"),
        )
    )
    levels = cut_lineage(levels)
    share = bm25_share(F.col("tf"), F.col("length"), average)

    def weighed(rows: DataFrame) -> DataFrame:
        return rows.join(idf, "term").withColumn("weight", F.col("idf") * share)

    big = levels.where("salts > 1").select("term", "bucket", "salts")
    salt = F.pmod(F.xxhash64(doc), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    rows = weighed(read("postings")).join(big, ["term", "bucket"], "left")
    rows = rows.select(doc, "term", "weight", "bucket", salt)

    # A term's heaviest postings in a segment, or all of them where they are few.
    common = cut_lineage(_common(sizes, ["segment", "term"]))

    def heavy(k: int) -> DataFrame:
        kept = read("heavy").join(common, ["segment", "term"], "left_semi")
        rare = read("postings").join(common, ["segment", "term"], "left_anti")
        found = weighed(kept.unionByName(rare)).select(doc, "term", "weight")
        return top_n(found, ["term"], [F.desc("weight"), F.asc(doc)], k).drop("rank")

    return Postings(rows, levels, heavy)


def search_terms(index: StoredIndex, query_terms: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """(query, doc, score, rank) of a BM25 index for (query, term, qweight), as `sparse_top_k` gives."""
    if index.kind != "bm25":
        raise ValueError("terms with weights are searched in a bm25 index")
    query_terms = cut_lineage(query_terms)
    return sparse_top_k(query_terms, _bm25_postings(index, query_terms), k, query, index.doc)


def search_texts(index: StoredIndex, queries: DataFrame, k: int, query: str, text: str) -> DataFrame:
    """(query, doc, score, rank) of a TF-IDF index for whole query texts."""
    if index.kind != "tfidf":
        raise ValueError("texts are searched in a tfidf index")
    asked = queries.select(query, F.col(text).alias("asked"))
    terms = exploded(asked, [query], words_and_pairs(F.col("asked")), "term").select("term")
    read = _pruned(index, terms)
    idf = cut_lineage(_tfidf_terms(index, read("sizes")))
    wanted = cut_lineage(tfidf_query_terms(asked, idf, query, "asked"))
    norms = index.spark.read.parquet(f"{index.root}/norms/version={index.version}")
    rows = read("postings").join(idf, "term").join(norms, index.doc)
    rows = rows.select(index.doc, "term", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight"))
    return sparse_top_k(wanted, rows, k, query, index.doc)
