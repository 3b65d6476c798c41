"""Operators for training data: text repair, similar vectors, near-duplicates, packing, leakage and subjects.

Nothing else in the library imports this subpackage.
"""
