"""Registered queries and their SQL."""

from . import extra_queries, file_queries, orientation_queries, plot_queries, point_queries, report_queries

_ALL = (point_queries, orientation_queries, plot_queries, extra_queries, file_queries, report_queries)
QUERIES = {name: q for module in _ALL for name, q in module.QUERIES.items()}
ORACLES = {name: sql for module in _ALL for name, sql in module.ORACLES.items()}
flagship = point_queries.flagship
