"""Operators over DataFrames: filters, searches, fusion, approximate search, merging of writes."""
