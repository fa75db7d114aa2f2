"""Sources and sinks: fixed-schema parquet snapshots, CSV inputs, JSON output, test-table mapping."""
