"""All named queries of the core and their SQL twins."""

from __future__ import annotations

from quern.plans import general, reference, reference_sql

QUERIES = {**reference.QUERIES, **general.QUERIES}
SQL: dict[str, str] = {**reference_sql.SQL, **general.SQL}
