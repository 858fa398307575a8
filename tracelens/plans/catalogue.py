"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from . import aggregates, answers, programs, relational, scalars  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
