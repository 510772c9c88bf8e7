"""Operators for preparing language-model training data with Spark.

Nothing else in the package imports this subpackage; it can be removed as a
whole.  Every operator takes and returns DataFrames.
"""
