"""Silver and gold models, read queries, checks and the full build.

A model is ``name(t, rounding=True, **constants) -> DataFrame`` where ``t`` maps
table names to DataFrames.
"""
