"""Spatial, raster, network and operational analytics on Spark DataFrames."""
