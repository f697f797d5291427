"""All queries of this subpackage."""

from spendlens.llm import conversations, decontaminate, divergence, extract, fingerprint, jaccard, language, packing, pii, secrets, shards, token_files, warc  # noqa: F401
from spendlens.llm.registry import ORACLES, QUERIES  # noqa: F401
