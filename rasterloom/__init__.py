"""Gridded geospatial coverages on PySpark: plan, fetch, decode, clean, assemble and query tiles."""

__version__ = "0.1.0"
