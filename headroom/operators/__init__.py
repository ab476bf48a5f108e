"""Capacity-planning operators: functions from DataFrames to a DataFrame."""
