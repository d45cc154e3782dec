"""Civic-data analytics as lazy Spark DataFrames.

Every plan function takes DataFrames and returns a DataFrame that answers the question for all
contests, bills, candidates or districts in one job; a selection is just an optional filter.
"""
