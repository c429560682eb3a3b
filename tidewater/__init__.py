"""Fishery statistics as plain functions from Spark DataFrames to Spark DataFrames."""
