"""Gridded, profile and daily-series analytics as Spark DataFrame transformations."""
