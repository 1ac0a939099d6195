"""Databases and collections: calls on the driver become plans over DataFrames."""
