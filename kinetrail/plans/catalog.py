"""All registered queries of the trajectory engine, and their DuckDB SQL."""

from __future__ import annotations

from . import geometry_queries, mask_queries, merge_queries, relational_queries, sequential_queries, series_queries, surface_queries, training_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (series_queries, relational_queries, geometry_queries, merge_queries, mask_queries, surface_queries, training_queries, sequential_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
