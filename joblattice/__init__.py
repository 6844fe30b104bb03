"""Listings analytics as Spark DataFrame jobs."""
