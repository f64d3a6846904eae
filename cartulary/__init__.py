"""Cartulary: file-inventory analytics on Spark DataFrames."""
