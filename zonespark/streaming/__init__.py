"""Importing files as they arrive."""
