"""Queries over the shared test tables, with SQL for the same rows."""
