"""Request planning and the registered queries."""

from . import catalog, catalog_plans

__all__ = ["catalog", "catalog_plans"]
