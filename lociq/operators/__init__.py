"""Operators over DataFrames of reads, intervals and calls."""
