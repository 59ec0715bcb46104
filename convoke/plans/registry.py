"""Queries by name and the SQL that gives the same rows."""

from __future__ import annotations

from convoke.plans import live, sessions, streams, views

QUERIES: dict = {**sessions.QUERIES, **streams.QUERIES, **views.QUERIES, **live.QUERIES}
ORACLE_SQL: dict[str, str] = {**sessions.ORACLE_SQL, **streams.ORACLE_SQL, **views.ORACLE_SQL, **live.ORACLE_SQL}
