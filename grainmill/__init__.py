"""Corpus-quality scoring and data-mixture analytics on Spark DataFrames."""
