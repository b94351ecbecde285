"""Every query by name with the SQL that checks it."""

from __future__ import annotations

from tapeworks.plans import core, evaluation, feeds

MODULES = [core, evaluation, feeds]
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in MODULES:
    QUERIES |= _m.catalog.queries.items()
    ORACLE_SQL |= _m.catalog.sql
