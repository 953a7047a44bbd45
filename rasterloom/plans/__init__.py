"""Tile plans as DataFrames, and the catalogue of registered queries."""
