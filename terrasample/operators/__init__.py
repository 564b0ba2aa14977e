"""Sampling, estimation, travel, routing, scheduling and allocation."""
