"""Feed readers (CSV / JSON payloads), table sinks and the test-table mapping."""
