"""Checks and expressions."""
