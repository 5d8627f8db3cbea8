"""Strandline: a Spark-first engine for ordered event series and item similarity."""
