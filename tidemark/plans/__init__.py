"""Composite queries and metadata workflows."""
