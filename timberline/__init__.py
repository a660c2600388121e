"""Catalog analytics as Spark DataFrame transformations."""
