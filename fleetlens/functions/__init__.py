"""Projections, filters and scalar functions."""
