"""The catalogue of core queries and their SQL counterparts, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from foliomill.plans import changes, points, results, texts

_MODULES = (changes, texts, points, results)


def queries() -> dict[str, Callable]:
    found: dict[str, Callable] = {}
    for m in _MODULES:
        found |= m.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _MODULES:
        found |= m.SQL
    return found
