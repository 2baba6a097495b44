"""Cross-sectional factor analytics on panels, expressed as Spark DataFrame jobs."""
