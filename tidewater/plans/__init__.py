"""Composite queries and the registry of all queries."""
