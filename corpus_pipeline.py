"""Corpus pipeline: language ID, near-duplicate removal, decontamination, PII redaction, packing.

Each stage takes the documents its predecessor kept and returns documents, but for the last, which returns the
pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlens.llm import decontaminate as benchmark
from spendlens.llm import jaccard, language, packing, pii
from spendlens.llm.registry import table
from spendlens.session import cut_lineage


def identify_language(spark, docs, sf_dir):
    """Documents with a language: all with a letter, as the cosine of a language without labels is noise.

    Null and empty texts, and texts without a letter, go; repeated rows all stay.
    """
    prototypes = language.learn_prototypes(docs.where(~language.held_out()).select("text", "lang"))
    return docs.where(language.predicted(F.col("text"), prototypes, spark)["lang_pred"] != language.UNKNOWN)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group that links of five-word shingles, 0.8 alike or more, form.

    Null texts stay; texts without words go only as exact copies; of rows of one id and one text one stays.
    """
    return jaccard.without_near_duplicates(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that share no window of ten words with the benchmark; null and empty texts stay."""
    return benchmark.without_contamination(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark, docs, sf_dir):
    """All documents, personal data replaced by its kind in brackets; n_chars follows the text.

    Null texts stay null, with a null n_chars; empty ones stay empty. Only the text takes part, so no other column
    can clash.
    """
    rest = F.struct(F.lit(None).alias("text"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    found = pii.find_spans(docs.select("text", rest.alias("row")), pii.learn(docs))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return pii.redacted(found).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark, docs, sf_dir):
    """Pieces of all documents in sequences of 1024 ids; null and empty texts are the end id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language id", identify_language),
    ("n-gram jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("best-fit packing", pack),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
