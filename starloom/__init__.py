"""Particle analytics on Spark: every operator takes DataFrames and returns DataFrames."""

__version__ = "0.1.0"
