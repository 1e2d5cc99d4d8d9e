"""Queries over the test tables, and SQL that must give the same rows."""
