"""Threat-intelligence analytics on Spark DataFrames."""
