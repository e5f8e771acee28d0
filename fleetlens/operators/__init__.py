"""Joins, aggregates, series, templates and scores."""
