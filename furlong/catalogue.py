"""All registered queries of the racing engine, and their SQL."""

from __future__ import annotations

from .plans import MODULES  # noqa: F401
from .plans.registry import ORACLE, QUERIES

FLAGSHIP = "w4_expanding"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
