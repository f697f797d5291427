"""Decontamination, near duplicates, fingerprints and language profiles against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spendlens.llm import decontaminate, fingerprint, jaccard, language, words
from spendlens.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, window string, score double, copy string"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def table(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", "w", 0.5, "c") for i, t in rows], DOCS)


def sentence(rng, n, words=4000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_words_of_long_and_short_texts(monkeypatch):
    monkeypatch.setattr(words, "BLOCK", 256)
    monkeypatch.setattr(words, "_powers", None)
    rng = random.Random(1)
    texts = ["", None, "  ,, ", "Éa-b", "x" * 700, sentence(rng, 400), sentence(rng, 30), "a b", "é" * 300 + " z"]
    for overlap in (0, 3, 12):
        found = defaultdict(list)
        for block in words.word_blocks(pa.array(texts), overlap):
            assert len(block.low) <= 3 * 256 + 800
            for i in range(block.skip, len(block.hash) - block.spare):
                row = block.first + int(block.row[i])
                found[row].append(block.text(i, i + 1))
            if block.skip or block.spare:
                assert block.before + block.skip == len(found[block.first]) - (len(block.hash) - block.spare - block.skip)
        for i, text in enumerate(texts):
            assert found[i] == plain_words(text)
    monkeypatch.setattr(words, "_powers", None)


def test_word_hash_does_not_depend_on_place():
    one = next(words.word_blocks(pa.array(["foo bar", "bar foo"]), 0))
    assert one.hash[0] == one.hash[3] and one.hash[1] == one.hash[2] and one.hash[0] != one.hash[1]


def brute_contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, ids = plain_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    ids |= found
        out.append((doc, len(w), len(hit), sorted(map(str, ids - {None}))))
    return out


def test_contamination(spark, monkeypatch):
    monkeypatch.setattr(words, "BLOCK", 512)
    monkeypatch.setattr(words, "_powers", None)
    rng = random.Random(2)
    items = [(i, sentence(rng, 40)) for i in range(6)]
    items += [(6, items[0][1]), (7, "only Three words"), (8, None), (9, " ... "), (None, items[1][1]), (10, "one")]
    docs = [(i, sentence(rng, rng.randrange(60))) for i in range(20)]
    for i in range(20, 50):
        a = rng.randrange(30)
        passage = " ".join(items[i % 6][1].split()[a : a + rng.randrange(5, 40)])
        docs.append((i, f"{sentence(rng, rng.randrange(200))}; {passage.upper()}\n{sentence(rng, 9)}"))
    docs += [(50, None), (51, ""), (52, "Only three WORDS!"), (53, "one two one"), (None, items[2][1]), (20, docs[20][1])]
    docs.append((54, " ".join(items[3][1] for _ in range(30))))
    found = decontaminate.contamination(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in found.collect()]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(got, key=key) == sorted(brute_contamination(docs, items), key=key)
    clean = {r[0] for r in got if not r[2]}
    kept = decontaminate.without_contamination(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert {r.doc_id for r in kept.collect()} == clean
    monkeypatch.setattr(words, "_powers", None)


def test_contamination_of_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(table(spark, [(1, "a b c")]), items).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(3, 0, False)]
    assert decontaminate.contamination(table(spark, []), items).count() == 0


def brute_links(docs, k=5, least=0.8):
    sets = {}
    for doc, text in docs:
        w = plain_words(text)
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    raw = dict(docs)
    links, parent = Counter(), {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            same = raw[a] is not None and raw[a] == raw[b] if not sets[a] or not sets[b] else (
                len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
            )
            if same:
                links[a] += 1
                links[b] += 1
                one, two = sorted((root(a), root(b)))
                parent[two] = one
    return {d: (root(d), links[d]) for d in ids}


@pytest.mark.parametrize("group_bytes", [8 << 20, 700])
def test_near_duplicates(spark, monkeypatch, group_bytes):
    """Groups of near copies in one block and in many."""
    monkeypatch.setattr(jaccard, "GROUP_BYTES", group_bytes)
    rng = random.Random(3)
    docs, n = [(i, sentence(rng, rng.randrange(3, 80))) for i in range(25)], 25
    for size in (2, 3, 30):
        base = sentence(rng, 80).split()
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(80)] = f"x{rng.randrange(999)}"
            docs.append((n, " ".join(copy)))
            n += 1
    docs += [(n, docs[0][1].upper()), (n + 1, docs[0][1]), (n + 2, None), (n + 3, None), (n + 4, ""), (n + 5, "")]
    docs += [(n + 6, "!!"), (n + 7, "two words"), (n + 8, "Two, words")]
    want = brute_links(docs)
    got = jaccard.near_duplicates(table(spark, docs)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want
    assert len(got) == len(docs)
    kept = jaccard.without_near_duplicates(table(spark, [*docs, docs[3], (None, docs[4][1])]))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in want.values()})


def test_near_duplicates_of_empty_table(spark):
    assert jaccard.near_duplicates(table(spark, [])).count() == 0


def test_band_choice():
    bands, rows = jaccard.choose_bands(0.8, 0.9999, 128)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128
    with pytest.raises(ValueError):
        jaccard.choose_bands(0.1, 0.999999, 4)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        one, two = sorted((root(a), root(b)))
        parent[two] = one
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {v for v in parent if all(a == b for a, b in edges if v in (a, b))}
    assert got == {v: root(v) for v in parent if v not in alone}


def test_fingerprint_pairs(spark):
    rng = random.Random(5)
    docs = [(i * 3, sentence(rng, rng.randrange(120), 90)) for i in range(40)]
    docs += [(200, None), (201, "é"), (202, "ab" * 40_000), (203, docs[0][1])]
    got = {r.doc_id: r for r in fingerprint.fingerprint_pairs(table(spark, docs)).collect()}
    assert len(got) == len(docs)
    for i, (doc, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        row = got[doc]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == fingerprint.digest(text.encode())
        assert row.edited_fingerprint == fingerprint.digest(edited.encode())
        assert row.near_edited == fingerprint.likeness(row.fingerprint, row.edited_fingerprint)
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
    assert got[0].fingerprint == got[203].fingerprint
    assert fingerprint.fingerprint_pairs(table(spark, [])).count() == 0
    alone = fingerprint.fingerprint_pairs(table(spark, [(1, "abcd")])).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"abca").hexdigest() and alone[0].near_next == 1
    twice = fingerprint.fingerprint_pairs(table(spark, [(1, "x"), (1, "x"), (None, "y"), (None, None)]))
    assert twice.count() == 4


def test_bucket_counts_in_blocks(monkeypatch):
    data = np.random.default_rng(6).integers(0, 256, 5000, dtype=np.uint8).tobytes()
    whole = fingerprint.bucket_counts(data)
    monkeypatch.setattr(fingerprint, "BLOCK", 257)
    assert (fingerprint.bucket_counts(data) == whole).all()
    assert whole.sum() == sum(5000 - b for _, b in fingerprint._PAIRS)
    assert fingerprint.difference(fingerprint.digest(data), fingerprint.digest(data[::-1])) <= fingerprint.MOST


def test_text_vectors_are_bound_letters(monkeypatch):
    space = language._space(64)
    text = "Ab, cé"
    symbols = " ab cé "
    want = np.zeros(64)
    for i in range(len(symbols) - 2):
        a, b, c = space.vectors(np.array([ord(s) for s in symbols[i : i + 3]])).astype(float)
        want += np.roll(a, 2) * np.roll(b, 1) * c
    got, lettered = language.text_vectors([text, None, "12 .", ""], 64)
    assert (got[0] == want).all() and lettered.tolist() == [True, False, False, False]
    rng = random.Random(7)
    long = " ".join(rng.choice(["der", "Lärm", "中文", "1,2", "x"]) for _ in range(900))
    whole, _ = language.text_vectors([long, "kurz", long], 64)
    monkeypatch.setattr(language, "BLOCK", 97)
    parts, _ = language.text_vectors([long, "kurz", long], 64)
    assert (whole == parts).all()


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prototypes = language.learn_prototypes(docs.where(~language.held_out()))
    found = language.identify(docs.where(language.held_out()), prototypes).collect()
    right = sum(r.lang == r.lang_pred for r in found)
    assert right >= 0.97 * len(found) and all(0 <= r.score <= 1 for r in found)
    odd = table(spark, [(1, None), (2, ""), (3, "12 ?!"), (None, "und der die das ist nicht von"), (4, "a")])
    rows = {r.doc_id: r for r in language.identify(odd, prototypes).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[1].score == 0
    assert rows[None].lang_pred == "de" and rows[4].lang_pred != "und" and rows[4].window == "w"
    assert language.learn_prototypes(table(spark, [(1, None)])) == {}
    assert [r.lang_pred for r in language.identify(table(spark, [(1, "abc")]), {}).collect()] == ["und"]
    assert language.identify(table(spark, []), prototypes).count() == 0


def test_block_pairs_are_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_TEXTS", 8)
    rng = random.Random(21)
    rows = [(i, 7, 1, size, sentence(rng, 5)) for i, size in enumerate([10] * 40 + [12] * 20 + [100] * 30 + [1])]
    texts = spark.createDataFrame(rows, "class long, component long, copies long, size long, text string")
    met = jaccard._met(texts, 0.8)
    keys = ["component", "level", "above", "one", "two"]
    plan = met.groupBy(*keys).applyInArrow(lambda t: t, met.schema)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(component") >= 1 and "hashpartitioning(component#" in plan
    assert any(all(k in line for k in keys) for line in plan.splitlines() if "hashpartitioning" in line)
    groups = {}
    for r in met.collect():
        groups.setdefault(tuple(r[k] for k in keys), []).append((r["class"], r.right, r.diagonal))
    meetings = set()
    for group in groups.values():
        left, right = [c for c, on, _ in group if not on], [c for c, on, _ in group if on]
        assert len(group) <= 60
        for a in left:
            for b in left if group[0][2] else right:
                pair = (min(a, b), max(a, b))
                assert a == b or group[0][2] or pair not in meetings
                meetings.add(pair)
    size = {r[0]: r[3] for r in rows}
    for a in size:
        for b in size:
            if a < b and min(size[a], size[b]) >= 0.8 * max(size[a], size[b]):
                assert (a, b) in meetings
    assert not any(size[a] == 10 and size[b] == 100 for a, b in meetings)
