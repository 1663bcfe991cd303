"""All queries of the library; importing the modules registers them."""

from __future__ import annotations

from . import decisions, evaluation, gates, gold, guards, library, pages, pools, retrieval, sinks, state, trees  # noqa: F401
from .registry import QUERIES, SQL, Query

FLAGSHIP = "hybrid_retrieval"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
