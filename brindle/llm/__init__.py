"""Operators for training-data pipelines over tables of documents and pages.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames,
keeps columns of its input that it doesn't define itself where it says so, and states in its
docstring what nulls, empty texts, ties, repeated rows and empty tables give.
"""
