"""All queries of the spatial library, by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoloom.plans import areas, checks, cliffs, contouring, details, faces, landing, lines, metrics, network, operations, raster, rules, shapes, spatial, surfaces, terrain, tidying
from geoloom.sources.tables import with_tables

FLAGSHIP = "agg02_grid_stats"
FAMILIES = (raster, rules, shapes, spatial, operations, areas, terrain, metrics, lines, surfaces, network, details, shapes, landing, checks, faces, contouring, cliffs, tidying)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(sql) for family in FAMILIES for name, sql in family.SQL.items()}
