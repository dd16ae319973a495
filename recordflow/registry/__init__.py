"""All queries over the test tables."""

from recordflow.registry import activity, catalog, forms, records, scalars, storage  # noqa: F401
from recordflow.registry.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
