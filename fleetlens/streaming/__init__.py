"""Tumbling aggregates over streams."""
