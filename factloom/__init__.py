"""Factloom: document collections to structured, versioned facts, on Spark DataFrames."""
