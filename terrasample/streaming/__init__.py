"""Incremental versions of estimators."""
