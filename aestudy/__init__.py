"""Actual-to-expected studies as Spark DataFrame programs."""
