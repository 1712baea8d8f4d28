"""Operators over graphs: building, lookups, traversal, reports and validation."""
