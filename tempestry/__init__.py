"""Tropical-cyclone imagery analytics on Spark DataFrames."""
