"""All registered queries of the core and their SQL."""

from __future__ import annotations

from quillmark.plans import corpus, gates, project, references, retrieval

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in (references, retrieval, project, gates, corpus):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
