"""Operators over DataFrames: chunking, manifest diff, vector store, search, reports."""
