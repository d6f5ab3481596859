"""Queries over the sample tables, and their SQL."""
