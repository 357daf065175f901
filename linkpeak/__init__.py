"""Worst-case link-load analytics as Spark jobs."""
