"""All queries over the driver's tables, by key, with their SQL where SQL can express them."""

from __future__ import annotations

from .plans import bars, control, fundamentals, series, supply

_PLANS = (bars, supply, control, fundamentals, series)
QUERIES: dict = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
ORACLE_SQL: dict = {k: q for p in _PLANS for k, q in p.ORACLE_SQL.items()}
