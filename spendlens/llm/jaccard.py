"""N-gram Jaccard join by MinHash banding.

Texts of equal words are one class. Bands of min-hash rows, as many as the recall asks for, bring classes
together; each bucket links its members to its least member only. Full shingle sets are compared inside the
components that these links form, in blocks, so a bucket's or component's pairs are never written out: blocks
give per class the links counted, and of the linked pairs a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.components import components
from spendlens.llm.files import fresh
from spendlens.llm.registry import query, table
from spendlens.llm.words import grams, mixed, word_blocks
from spendlens.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.9999
HASHES = 128  # most min-hashes a signature may take
GROUP_BYTES = 4 << 20  # text that one side of a block of comparisons holds on average
GROUP_TEXTS = 1024  # and texts


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance candidates, that reach the recall at the similarity."""
    best = None
    for rows in range(1, hashes + 1):
        p = similarity**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding of that many hashes reaches the recall")
    return best


def _row_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Per text: number of words, digest of the words in order, sorted distinct shingle hashes.

    A text of fewer than k words, but not none, has one shingle of all its words.
    """
    n = len(column)
    counts, digest = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.uint64)
    parts: list[list[np.ndarray]] = [[] for _ in range(n)]
    heads: list[list[np.ndarray]] = [[] for _ in range(n)]
    for words in word_blocks(column, k):
        own = slice(words.skip, len(words.hash) - words.spare)
        rows = words.last - words.first
        row = words.row[own]
        number = np.bincount(row, minlength=rows)
        place = words.before + words.skip + np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        place = mixed(place.astype(np.uint64))
        np.add.at(digest, row + words.first, mixed(words.hash[own] * (place | np.uint64(1))))
        counts[words.first : words.last] += number
        hashes, ok = grams(words, k)
        ok = ok.copy()
        ok[: words.skip] = False
        ok[own.stop :] = False
        at = np.flatnonzero(ok)
        edge = np.searchsorted(words.row[at], np.arange(rows + 1))
        word_edge = np.searchsorted(words.row, np.arange(rows + 1))
        for i in range(rows):
            if edge[i + 1] > edge[i]:
                parts[words.first + i].append(hashes[at[edge[i] : edge[i + 1]]])
            elif word_edge[i + 1] > word_edge[i]:
                heads[words.first + i].append(words.hash[word_edge[i] : word_edge[i + 1]])
    digest = mixed(digest + counts.astype(np.uint64))
    none = np.zeros(0, dtype=np.uint64)
    sets = []
    for i in range(n):
        if parts[i]:
            sets.append(np.unique(np.concatenate(parts[i])))
        else:
            sets.append(digest[i : i + 1] if counts[i] else none)
    return counts, digest, sets


def _signatures(bands: int, rows: int, k: int):
    rng = np.random.Generator(np.random.PCG64(20_240_601))
    factor = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            counts, digest, sets = _row_sets(batch.column(2), k)
            found = []
            for values in sets:
                if not len(values):
                    found.append(None)
                    continue
                least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(values), 2048):
                    some = values[at : at + 2048, None] * factor + shift
                    np.minimum(least, (some ^ (some >> np.uint64(31))).min(axis=0), out=least)
                key = np.zeros(bands, dtype=np.uint64)
                for j in range(rows):
                    key = mixed(key * factor[:bands] + least[j::rows])
                found.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(counts),
                    pa.array(digest.view(np.int64)),
                    pa.array([len(values) for values in sets], type=pa.int64()),
                    pa.array(found, type=pa.list_(pa.int64())),
                ],
                names=["doc_id", "copy", "n_words", "digest", "size", "bands"],
            )

    return run


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, weight: np.ndarray, least: float):
    """Links among `left`, or from `left` to `right`: added weights per member and a spanning forest."""
    both = left if right is None else np.concatenate([left, right])
    sizes = np.array([len(sets[i]) for i in both])
    flat = np.concatenate([sets[i] for i in both])
    owner = np.repeat(np.arange(len(both)), sizes)
    order = np.argsort(flat, kind="stable")
    owner = owner[order]
    new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
    first = np.flatnonzero(new)
    column = np.cumsum(new) - 1
    shared = np.diff(np.append(first, len(flat))) > 1  # shingles of one set only add nothing to intersections
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    width = int(shared.sum())
    links = np.zeros(len(both), dtype=np.int64)
    parent = np.arange(len(both))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest = []
    rows = np.arange(len(left))
    others = rows if right is None else np.arange(len(left), len(both))
    common = np.zeros((len(rows), len(others)), dtype=np.float32)
    for at in range(0, width, 1024):
        some = (column >= at) & (column < at + 1024)
        block = np.zeros((len(both), min(1024, width - at)), dtype=np.float32)
        block[owner[some], column[some] - at] = 1
        common += block[rows] @ block[others].T
    union = sizes[rows][:, None] + sizes[others][None, :] - common
    linked = common >= least * union - 1e-6
    if right is None:
        np.fill_diagonal(linked, False)
    links[rows] += linked @ weight[others]
    if right is not None:
        links[others] += linked.T @ weight[rows]
    for i, j in zip(*np.nonzero(linked)):
        a, b = root(int(rows[i])), root(int(others[j]))
        if a != b:
            parent[b] = a
            forest.append((int(both[rows[i]]), int(both[others[j]])))
    return both, links, forest


def _compare(k: int, least: float):
    def run(frame: pa.Table) -> pa.Table:
        _, _, sets = _row_sets(frame.column("text"), k)
        ids = np.array(frame.column("class").to_numpy())
        copies = np.array(frame.column("copies").to_numpy())
        right = np.array(frame.column("right").to_numpy(zero_copy_only=False))
        order = np.argsort(ids, kind="stable")
        one, two = order[~right[order]], order[right[order]]
        diagonal = frame.column("diagonal")[0].as_py()
        out_ids, out_links, out_a, out_b = [], [], [], []
        if diagonal or (len(one) and len(two)):
            weight = copies[one] if diagonal else np.concatenate([copies[one], copies[two]])
            both, links, forest = _linked(sets, one, None if diagonal else two, weight, least)
            hit = links > 0
            out_ids, out_links = ids[both[hit]].tolist(), links[hit].tolist()
            out_a = [int(ids[a]) for a, _ in forest]
            out_b = [int(ids[b]) for _, b in forest]
        n, m = len(out_ids), len(out_a)
        return pa.table(
            {
                "class": pa.array(out_ids + [None] * m, pa.int64()),
                "links": pa.array(out_links + [None] * m, pa.int64()),
                "a": pa.array([None] * n + out_a, pa.int64()),
                "b": pa.array([None] * n + out_b, pa.int64()),
            }
        )

    return run


def _met(texts: DataFrame, similarity: float) -> DataFrame:
    """Every text once per block pair it takes part in: component, level, above, one, two (the pair), diagonal, right.

    Sets that are `similarity` alike differ in size by that ratio at most. With levels one ratio wide only texts of
    one level and of neighbouring levels need to meet. A level is cut into blocks by a hash; each pair of blocks is
    a task of its own.
    """
    step = -math.log(similarity) if similarity < 1 else math.inf
    level = F.floor(F.log(F.col("size").cast("double")) / step) if 0 < step < math.inf else F.col("size")
    texts = texts.withColumn("level", level.cast("long"))
    sizes = texts.groupBy("component", "level").agg(
        F.greatest(
            F.ceil(F.sum(F.octet_length("text") + 64) / GROUP_BYTES), F.ceil(F.count("*") / GROUP_TEXTS)
        ).alias("blocks")
    )
    below = sizes.select("component", (F.col("level") + 1).alias("level"), F.col("blocks").alias("below"))
    above = sizes.select("component", (F.col("level") - 1).alias("level"), F.col("blocks").alias("above"))
    sizes = sizes.join(below, ["component", "level"], "left").join(above, ["component", "level"], "left")
    blocked = texts.join(cut_lineage(sizes), ["component", "level"])
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("class"), "blocks"))

    def others(n: str, pair):
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), pair)).otherwise(F.array())

    def met(level, above: bool, one, two, diagonal, right):
        return F.struct(
            level.alias("level"),
            F.lit(above).alias("above"),
            one.alias("one"),
            two.alias("two"),
            diagonal.alias("diagonal"),
            right.alias("right"),
        )

    here, level, no = F.col("block"), F.col("level"), F.lit(False)
    same = others("blocks", lambda o: met(level, False, F.least(here, o), F.greatest(here, o), here == o, here > o))
    up = others("above", lambda o: met(level, True, here, o, no, no))
    down = others("below", lambda o: met(level - 1, True, o, here, no, F.lit(True)))
    pairs = blocked.select("component", "class", "copies", "text", F.explode(F.concat(same, up, down)).alias("met"))
    pairs = pairs.select("component", "class", "copies", "text", "met.*")
    return pairs.repartition("component", "level", "above", "one", "two")


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    k: int = SHINGLE,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, copy, class_id (least doc_id over all that links lead to), copy_id (least
    doc_id of the same words), n_links (other rows whose shingle sets are at least `similarity` alike), first
    (whether the row is the one its class is named after).

    Words are those of `words.py`. Texts without words are linked only to rows of exactly the same text; null
    texts to none. Repeated rows are copies of each other. Null ids take part, but never name a class unless
    all its ids are null. `copy` is a digest of the text that tells rows of one id apart.
    """
    bands, rows = choose_bands(similarity, recall)
    given = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text)).alias("copy"),
        F.col(text).cast("string").alias("text"),
    )
    schema = "doc_id long, copy long, n_words long, digest long, size long, bands array<long>"
    signed = cut_lineage(given.mapInArrow(_signatures(bands, rows, k), schema))
    # Wordless texts are told apart by their digest of all characters, null texts stay alone.
    has_words = F.col("n_words") > 0
    alone = ~has_words & (F.col("copy") == F.xxhash64(F.lit(None).cast("string")))
    signed = signed.withColumn("class", F.when(has_words, F.col("digest")).otherwise(F.xxhash64("copy", F.lit(1))))
    signed = signed.withColumn("alone", alone)
    classes = cut_lineage(
        signed.where(~F.col("alone"))
        .groupBy("class")
        .agg(
            F.count("*").alias("copies"),
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "copy")).alias("from"),
            F.first("size").alias("size"),
            F.first("bands", ignorenulls=True).alias("bands"),
        )
    )
    keys = classes.select("class", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("band", "key").agg(F.min("class").alias("b"), F.max("class").alias("most"))
    stars = (
        keys.join(buckets.where("b != most").drop("most"), ["band", "key"])
        .where(F.col("class") != F.col("b"))
        .select(F.col("class").alias("a"), "b")
        .distinct()
    )
    near = cut_lineage(components(stars).withColumnRenamed("id", "class"))
    # One text per class joins its component; the text stands for its shingle set.
    chosen = near.join(classes.select("class", "copies", "size", "from"), "class").select(
        "class", "component", "copies", "size", F.col("from.doc_id").alias("doc_id"), F.col("from.copy").alias("copy")
    )
    texts = given.where("text is not null").alias("g").join(
        chosen.alias("c"),
        F.col("g.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("g.copy") == F.col("c.copy")),
    )
    texts = texts.select("class", "component", "copies", "size", "g.text").dropDuplicates(["class"])
    texts = cut_lineage(texts)
    verified = cut_lineage(
        _met(texts, similarity)
        .groupBy("component", "level", "above", "one", "two")
        .applyInArrow(_compare(k, similarity), "class long, links long, a long, b long")
    )
    links = verified.where("class is not null").groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(verified.where("a is not null").select("a", "b")).withColumnRenamed("id", "class")
    members = classes.select("class", "from", "copies").join(joined, "class", "left").join(links, "class", "left")
    members = members.withColumn("component", F.coalesce("component", "class"))
    named = members.groupBy("component").agg(F.min("from").alias("first"))
    members = cut_lineage(members.join(named, "component").drop("component"))
    together = signed.where(~F.col("alone")).join(members, "class")
    out = together.select(
        "doc_id",
        "copy",
        F.col("first.doc_id").alias("class_id"),
        F.col("from.doc_id").alias("copy_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("copy") == F.col("first.copy"))).alias("first"),
    )
    own = [F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links")]
    return out.union(signed.where("alone").select("doc_id", "copy", *own, F.lit(True).alias("first")))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of each class (least id, then text digest), with all its columns.

    Of rows of one id and one text a single one stays. The keys are plain columns, so that the join and the
    removal of repeats share one shuffle of the texts.
    """
    names = fresh(docs, "near_id", "near_null", "near_copy")
    ids = F.col(id_col).cast("long")
    found = near_duplicates(docs, id_col=id_col, text=text).where("first")
    kept = found.select(
        *[c.alias(n) for c, n in zip([F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), F.col("copy")], names)]
    )
    key = [F.coalesce(ids, F.lit(0)), ids.isNull(), F.xxhash64(F.col(text))]
    rows = docs.select("*", *[c.alias(n) for c, n in zip(key, names)]).join(kept, names, "left_semi")
    return rows.dropDuplicates(names).drop(*names)


@query("op7_minhash_jaccard_join")
def op7_minhash_jaccard_join(spark, sf):
    return near_duplicates(table(spark, sf, "documents")).drop("copy", "first")
