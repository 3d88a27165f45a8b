"""Ready queries over the given tables, each with equivalent SQL where SQL can say it.

Every module has ``QUERIES`` (name -> function of session and table folder) and ``SQL``.
"""

from pagequarry.plans import (
    crawl_plans,
    frontier_plans,
    index_plans,
    page_plans,
    search_plans,
    site_plans,
    stats_plans,
    stream_plans,
)

_MODULES = (
    search_plans,
    page_plans,
    site_plans,
    frontier_plans,
    index_plans,
    stats_plans,
    stream_plans,
    crawl_plans,
)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
