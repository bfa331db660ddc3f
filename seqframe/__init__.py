"""Sequence analytics on Spark DataFrames: typed sequences, qualities, alignments and ordered dataflow as columns and tables."""
