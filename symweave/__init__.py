"""Symweave: ordered symbol sequences, codecs and succinct queries on Spark DataFrames."""
