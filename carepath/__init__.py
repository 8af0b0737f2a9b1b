"""Cohort analytics on coded event data, expressed as Spark DataFrame operations."""
