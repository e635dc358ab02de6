"""Queries of the library over the test tables."""

from saltmarsh.plans import answers, bakes, event_lists, feeds, guards, matches, posts, registry_figures, reports, retrieval, review, scores, stats, store, streams, texts, tracking, values, venues, work  # noqa: F401  they register their queries
from saltmarsh.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "map_territories"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
