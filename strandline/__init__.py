"""Time-series, dependence, validation, spatial and graph analytics over Spark tables.

Every operator takes DataFrames and column names and returns a lazy DataFrame.
"""
