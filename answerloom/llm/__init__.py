"""Operators for preparing text corpora as model training data.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; what has to outlive a stage goes to the shared checkpoint folder.
"""
