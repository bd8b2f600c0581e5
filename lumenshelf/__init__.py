"""Catalog intelligence and corpus preparation on Spark."""
