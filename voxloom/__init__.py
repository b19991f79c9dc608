"""Volumetric morphometry on Spark DataFrames."""
