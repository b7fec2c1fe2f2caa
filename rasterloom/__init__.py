"""Raster, catalog and feature-matching analytics as Spark DataFrame jobs."""
