"""Operators: functions from DataFrames to DataFrames, each keyed by a response or image."""
