"""Sources: table scans and readers."""

from siltstone.sources.tables import table

__all__ = ["table"]
