"""Operators on boxes, tiles and pixels."""
