"""Operators of a training-data pipeline (scoring, near-duplicates, mixing, sharding, token files).

Nothing else in the library imports this subpackage.
"""
