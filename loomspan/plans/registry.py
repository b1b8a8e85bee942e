"""Queries of the alignment operators, with their SQL."""

from __future__ import annotations

from loomspan.plans import alignment_queries, potential_queries, profile_queries

QUERIES = {**profile_queries.QUERIES, **alignment_queries.QUERIES, **potential_queries.QUERIES}
ORACLE_SQL = {**profile_queries.ORACLE_SQL, **alignment_queries.ORACLE_SQL, **potential_queries.ORACLE_SQL}
