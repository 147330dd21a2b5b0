"""Equity screening and corporate-event analytics as PySpark DataFrame jobs."""
