"""All core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from sangam.plans import corpus, costs, evaluation, files, gates, reports

MODULES = (corpus, gates, costs, reports, evaluation, files)


def queries() -> dict[str, Callable]:
    return {k: v for m in MODULES for k, v in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
