"""Relational operators of the retrieval pipeline, DataFrame in, DataFrame out."""
