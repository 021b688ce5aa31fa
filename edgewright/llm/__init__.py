"""Operators for training-data work on texts, triples and graphs.

Nothing outside this subpackage imports it.
"""
