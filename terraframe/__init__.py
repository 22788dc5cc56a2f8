"""Raster analytics on Spark: scenes are DataFrames of pixels, operators are plans."""
