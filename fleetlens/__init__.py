"""Service telemetry analytics on Spark: tolerant ingestion, alignment, templates, edges, windows and scores."""
