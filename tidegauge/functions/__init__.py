"""Durations and aggregates."""
