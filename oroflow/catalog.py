"""Registry of the terrain, drainage, feature and streaming queries and of their SQL oracles."""

from __future__ import annotations

from functools import lru_cache

from .plans import channel_queries, feature_queries, hydro_queries, line_queries, sphere_queries, store_queries, terrain_queries


@lru_cache(1)
def _all() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for module in (terrain_queries, hydro_queries, channel_queries, feature_queries, store_queries, line_queries, sphere_queries):
        found |= module.build()
    return found


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
