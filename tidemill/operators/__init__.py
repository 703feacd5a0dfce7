"""Operators: functions from DataFrames to a DataFrame, none of which runs a driver-side row loop."""
