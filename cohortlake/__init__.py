"""Cohort extraction and analytics as plain Spark DataFrame functions."""
