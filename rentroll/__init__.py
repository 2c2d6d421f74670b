"""Lease-finance and sales reporting on Spark DataFrames."""
