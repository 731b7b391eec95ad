"""Queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from seamline.plans import boundaries, by_name, extras, kernels, metrics, oracle_rows, prior, sampling, scheduling, stateful

_PLANS = (boundaries, sampling, metrics, kernels, extras, prior, oracle_rows, stateful, scheduling, by_name)
QUERIES = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
ORACLE_SQL = {k: s for p in _PLANS for k, s in p.ORACLE_SQL.items()}
