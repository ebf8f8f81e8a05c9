"""Registered queries: each binds operators to views over the given tables."""

from __future__ import annotations

from . import capacities, catalogs, exports, installs, inventories, states, streams, texts, ttls, versions
from .views import plain

_GROUPS = (versions, catalogs, states, installs, inventories, capacities, ttls, texts, exports, streams)

QUERIES = {name: run for group in _GROUPS for name, run in group.QUERIES.items()}
ORACLE = {name: plain(sql) for group in _GROUPS for name, sql in group.ORACLE.items()}
