"""Registered queries and their oracle SQL."""

from __future__ import annotations

from .plans import activity, admin, anomalies, crawls, decisions, facts, grid, identity, incremental, landed, makers, parts, profiles, streams, transitions

_PLANS = [grid, activity, facts, identity, incremental, transitions, admin, profiles, landed, anomalies, streams, crawls, decisions, makers, parts]
QUERIES: dict = {k: v for p in _PLANS for k, v in p.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for p in _PLANS for k, v in p.ORACLE.items()}
