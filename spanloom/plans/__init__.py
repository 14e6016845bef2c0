"""The query slate: modules with ``QUERIES``, and the SQL of most of them."""

from . import analysis_queries, analysis_sql, curation_queries, generation_queries, media_queries, retrieval_queries, reward_queries, sequence_queries, serving_queries, statistics_queries

_MODULES = (retrieval_queries, sequence_queries, analysis_queries, generation_queries, curation_queries, reward_queries, statistics_queries, media_queries, serving_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in (*_MODULES, analysis_sql) for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
