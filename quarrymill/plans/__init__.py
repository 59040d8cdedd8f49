"""Composite jobs and the registry of queries."""
