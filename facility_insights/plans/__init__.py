"""Composite jobs, the query registry and the SQL oracle."""
