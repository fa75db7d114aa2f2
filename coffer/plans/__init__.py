"""Write handlers re-aimed as batch jobs: (state tables, request log) -> new tables."""
