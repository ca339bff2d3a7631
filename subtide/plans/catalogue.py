"""The registry of the core's queries and their SQL."""

from __future__ import annotations

from subtide.plans import memory, periods, texts, timeline

_MODULES = (periods, timeline, texts, memory)


def queries() -> dict:
    out: dict = {}
    for module in _MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _MODULES:
        out |= module.SQL
    return out
