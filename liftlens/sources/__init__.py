"""Table sources and sinks: named-table IO (IO1-IO6) and the test-table adapter (IO7)."""

from liftlens.sources.tables import TableStore, ensure_schema
from liftlens.sources.testdata import TestTables

__all__ = ["TableStore", "ensure_schema", "TestTables"]
