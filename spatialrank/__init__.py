"""Spatial priority ranking on Spark DataFrames.

A landscape is one sparse fact table ``occ(y, x, feature, value)`` with dimension tables beside it; every operator is
a function from DataFrames to a DataFrame.
"""
