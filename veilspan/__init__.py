"""Spark-native text privacy and leak analytics.

Everything here takes and returns DataFrames or Columns; there are no Python
workers in the plans.
"""
