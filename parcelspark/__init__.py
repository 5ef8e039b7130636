"""Property analytics on Spark: ingest, constraint search, scoring and evaluation as DataFrame plans."""
