"""The registered queries and their DuckDB equivalents."""
