"""Sessions, the test-table adapter, and the registered queries with their SQL equivalents."""
