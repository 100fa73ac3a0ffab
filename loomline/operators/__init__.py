"""Operators over DataFrames: selection, joins, graphs, statistics, and the corpus workflow."""
