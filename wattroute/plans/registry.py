"""All queries of the library and their SQL."""

from __future__ import annotations

from wattroute.plans import catalogue, drives, field, journeys, lines, planning, stops

MODULES = [catalogue, journeys, planning, field, stops, lines, drives]
QUERIES = [q for m in MODULES for q in m.QUERIES]
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
