"""All queries outside the llm subpackage."""

from __future__ import annotations

from tessera.plans import file_queries, format_queries, more_queries, relational_queries

QUERIES = {**relational_queries.QUERIES, **format_queries.QUERIES, **more_queries.QUERIES, **file_queries.QUERIES}
ORACLES = {**relational_queries.ORACLES, **format_queries.ORACLES, **more_queries.ORACLES, **file_queries.ORACLES}
