"""Layered ELT and area-by-period panel analytics on PySpark DataFrames."""
