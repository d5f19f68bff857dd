"""Operators of a training-data pipeline: ten large-scale text, vector and archive operators.

Nothing else in the library imports this subpackage.
"""
