"""Versioned tables as Spark DataFrame transformations."""
