"""Every query outside the training-data subpackage by name, and its SQL twin where there is one."""

from __future__ import annotations

from . import knowledge, knowledge_more, project_queries, relational, repositories, streams, syntax_queries

QUERIES = {**knowledge.QUERIES, **knowledge_more.QUERIES, **relational.QUERIES, **repositories.QUERIES, **streams.QUERIES, **syntax_queries.QUERIES, **project_queries.QUERIES}
ORACLE_SQL = {**knowledge.ORACLE_SQL, **knowledge_more.ORACLE_SQL, **relational.ORACLE_SQL, **repositories.ORACLE_SQL, **streams.ORACLE_SQL, **syntax_queries.ORACLE_SQL, **project_queries.ORACLE_SQL}
ORACLE_SQL["stream_idle_sessions"] = knowledge.ORACLE_SQL["idle_sessions"]
