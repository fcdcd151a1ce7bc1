"""Operators for large text corpora (training-data preparation).

Nothing outside this folder imports it; ``registry`` lists its queries.
"""
