"""All queries of the library but those of the training-data subpackage, and their equivalents in SQL."""

from textloom.plans import checks, corpus, operations, retrieval, store  # noqa: F401
from textloom.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
