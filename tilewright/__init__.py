"""Spatial annotations and tiled images on Spark DataFrames."""
