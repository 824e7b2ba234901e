"""Relational, spatial, vector and raster operators on DataFrames."""
