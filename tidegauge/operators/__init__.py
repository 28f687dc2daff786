"""Analytical operators, each from DataFrames to tidy DataFrames."""
