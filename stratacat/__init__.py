"""Catalog analytics and data processing on Spark."""
