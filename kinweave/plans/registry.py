"""All registered queries of the network engine and their SQL."""

from __future__ import annotations

from kinweave.plans import community, graph, groups, study

_PLANS = [groups, graph, community, study]

QUERIES = {k: v for p in _PLANS for k, v in p.QUERIES.items()}
ORACLE_SQL = {k: v for p in _PLANS for k, v in p.ORACLE_SQL.items()}
