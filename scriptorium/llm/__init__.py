"""Operators of a training-data pipeline, one module each, on Spark DataFrames.

Nothing else in the library imports this subpackage; it uses the session
helpers of the library and its own ``common`` module.
"""
