"""All registered checks."""

from checks import eval_queries, kb_queries, search_queries, statement_queries, text_queries, train_queries  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
