"""All queries of the mailbox operators by name, with DuckDB SQL."""

from lettermill.plans import classify_queries, intake_queries, markup_queries, profile_queries, store_queries, stream_queries, text_queries

QUERIES, ORACLE_SQL = {}, {}
for _module in (profile_queries, classify_queries, store_queries, text_queries, stream_queries, markup_queries, intake_queries):
    QUERIES |= _module.Q.queries
    ORACLE_SQL |= _module.Q.sql
