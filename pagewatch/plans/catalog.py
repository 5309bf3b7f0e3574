"""All registered queries."""

from __future__ import annotations

from pagewatch.plans import (  # noqa: F401
    catalog_items,
    catalog_pages,
    catalog_records,
    catalog_signals,
    catalog_streams,
    catalog_tables,
    catalog_urls,
)
from pagewatch.plans.registry import CATALOG

__all__ = ["CATALOG"]
