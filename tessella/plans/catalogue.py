"""All registered queries of the library."""

from tessella.plans import annotation_queries, file_queries, metric_queries, placement_queries, raster_queries, spatial_queries  # noqa: F401
from tessella.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
