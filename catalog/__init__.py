"""Named queries over the given tables and the SQL that checks them."""

from catalog import models, pipelines, rolling, scans  # noqa: F401  (registers the queries)
from catalog.registry import QUERIES

__all__ = ["QUERIES"]
