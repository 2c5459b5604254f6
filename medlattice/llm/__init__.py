"""Operators for training data: sampling, splitting, personal data, near duplicates, broken pairs, packing, mixing, reading level.

Nothing else in the package imports this subpackage.
"""
