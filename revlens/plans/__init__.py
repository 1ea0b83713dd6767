"""Named queries (catalogue) and their DuckDB oracle statements."""
