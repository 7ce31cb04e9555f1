"""All queries of the library on the driver's tables, and their SQL."""

from noticeforge.plans import notices, notices_sql, pages, pages_sql, positions, positions_sql, runs, runs_sql

QUERIES = positions.QUERIES | pages.QUERIES | runs.QUERIES | notices.QUERIES
ORACLE_SQL = positions_sql.ORACLE_SQL | pages_sql.ORACLE_SQL | runs_sql.ORACLE_SQL | notices_sql.ORACLE_SQL
