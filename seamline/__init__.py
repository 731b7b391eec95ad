"""Seamline: segmented-text, boundary-trace and evaluation analytics on Spark DataFrames."""
