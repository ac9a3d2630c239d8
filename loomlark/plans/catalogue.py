"""All registered queries of the reference's operators and their DuckDB equivalents."""

from __future__ import annotations

from loomlark.plans import dialects, ingest, lines, relations, sessions

_PARTS = (sessions.R, lines.R, relations.R, ingest.R, dialects.R)
QUERIES = {k: f for r in _PARTS for k, f in r.queries.items()}
ORACLE = {k: s for r in _PARTS for k, s in r.oracle.items()}
