"""Colophon: text annotation and contingency statistics on Spark DataFrames."""
