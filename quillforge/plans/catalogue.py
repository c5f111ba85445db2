"""All queries of the engine and their SQL."""

from __future__ import annotations

from quillforge.plans import audits, documents, oracle, tournament

QUERIES = {**tournament.QUERIES, **audits.QUERIES, **documents.QUERIES}
ORACLE_SQL = {**oracle.ORACLE_SQL, **audits.ORACLE_SQL, **documents.ORACLE_SQL}
#: Queries that SQL can't express.
WITHOUT_SQL = ("html_to_markdown", "paragraph_repair", *documents.WITHOUT_SQL)
