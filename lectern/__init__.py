"""Corpus and conversation analytics on Spark DataFrames."""
