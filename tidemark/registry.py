"""All registered queries of the engine's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import lake_queries, market_queries, micro_queries, model_queries, news_queries, research_queries, study_queries

MODULES = (market_queries, research_queries, news_queries, model_queries, lake_queries, micro_queries, study_queries)
QUERIES = {k: f for m in MODULES for k, f in m.catalogue.queries.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.catalogue.sql.items()}
FLAGSHIP = QUERIES["bollinger_zscore"]
