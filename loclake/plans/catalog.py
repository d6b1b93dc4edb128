"""Registry of the core's queries and their SQL."""

from __future__ import annotations

from loclake.plans import extra_queries, flow_queries, more_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **flow_queries.QUERIES, **more_queries.QUERIES, **extra_queries.QUERIES}
SQL: dict[str, str] = {**text_queries.SQL, **flow_queries.SQL, **more_queries.SQL, **extra_queries.SQL}
