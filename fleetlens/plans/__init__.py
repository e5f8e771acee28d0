"""Whole lifecycles, and the driver's tables seen as telemetry."""
