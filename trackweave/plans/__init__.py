"""Queries over the driver's tables, with the SQL that gives the same rows."""

from . import catalog, catalog_joins, catalog_more, catalog_overlay, catalog_references, catalog_rest
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "catalog_joins", "catalog_more", "catalog_overlay", "catalog_references", "catalog_rest"]
