"""Temporal state, label and validation analytics as Spark DataFrame jobs."""
