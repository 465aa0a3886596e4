"""Queries on the test tables and their SQL twins."""
