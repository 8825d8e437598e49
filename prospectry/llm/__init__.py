"""Operators for training-data pipelines over tables of documents, pages and conversations.

Nothing outside this package imports it.
"""
